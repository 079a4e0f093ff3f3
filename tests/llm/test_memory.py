"""What Python workers hold between tasks."""

import re
import sys
from pathlib import Path

import numpy as np
import pytest

from tandem.llm import common


def held() -> int:
    """MB of this process, without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_freed_memory_goes_back():
    """Many arrays below the size that is mapped by itself, with one above them that stays, as what a worker keeps may lie."""
    kept = []

    def run(batches):
        for b in batches:
            many = [np.ones(8000) for _ in range(3200)]
            kept.append(np.ones(8000))
            yield b + len(many)

    before = held()
    assert list(run([1])) == [3201] and held() - before > 150
    assert list(common.trimmed(run)([1, 2])) == [3201, 3202] and held() - before < 50
