"""The scan behind keywords finds what the rules find without them."""

import re

from tandem.llm import licenses


def variants(op, arg):
    name = str(op)
    if name == "LITERAL":
        return [chr(arg)]
    if name == "IN":
        return [chr(x) for o, a in arg for x in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))]
    if name == "BRANCH":
        return [t for b in arg[1] for t in texts(b)]
    if name == "SUBPATTERN":
        return texts(arg[-1])
    if name == "MAX_REPEAT":
        return ([""] if arg[0] == 0 else []) + texts(arg[2])
    assert name == "ASSERT"
    return [""]


def texts(parsed):
    """Texts that between them take each alternative of a regular expression."""
    parts = [variants(*x) for x in parsed]
    least = [p[0] for p in parts]
    return ["".join(least)] + ["".join([*least[:i], v, *least[i + 1 :]]) for i, p in enumerate(parts) for v in p[1:]]


def of_rule(r):
    """Texts of which each matches by itself, from the rule's regular expression."""
    return [t.strip() for t in dict.fromkeys(texts(re._parser.parse(r["regex"]))) if re.search(r["regex"], t + " ")]


def test_each_alternative_holds_a_keyword():
    for r in licenses.rules():
        found = of_rule(r)
        assert found
        for t in found:
            assert any(k in t for k in licenses.KEYWORDS), (r["regex"], t)
            assert any(k in f" {t} " for k in r["keywords"]), (r["regex"], t)


def test_gated_scan(spark):
    """On a text for each alternative of the rules that are a name by itself or a machine-readable line, as brute force."""
    rules = licenses.rules()
    tried = sorted({t for r in rules if r["priority"] in (40, 90) for t in of_rule(r)} | {"mit no attribution", "expat license", "library general public license", "psf license", "open data commons database license"})
    got = licenses.scan(spark.createDataFrame([(i, t.replace(" ", "\n")) for i, t in enumerate(tried)], "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(tried)
    patterns = [(r, re.compile(r["regex"])) for r in rules]
    for row in got:
        s = f" {tried[row['doc_id']]} "
        top = max(r["priority"] for r, p in patterns if p.search(s))
        labels = {r["label"] for r, p in patterns if r["priority"] == top and (m := p.search(s)) and m.end() - m.start() == max(x.end() - x.start() for q, y in patterns if q["priority"] == top and (x := y.search(s)))}
        kept = [d for d in row["detections"] if d["priority"] == top]
        assert kept and {d["label"] for d in kept} & labels, s
