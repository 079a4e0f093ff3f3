"""GraphML files against lines made in Python, and without a row of the driver's for each of them."""

from xml.sax.saxutils import escape, quoteattr

from tandem.operators import lines, outputs


def _clean(s):
    return "".join(c for c in str(s) if c >= " " or c in "\t\n\r")


def test_graphml_lines_are_packed(spark, tmp_path, monkeypatch):
    """Names and texts with marks, control characters, line ends and nulls, a null account in loops, many edges in several batches."""
    odd = ["a&b", 'q"', "q'", "q\"'", "l\n\r\tx", "c\x01\x1f<>", "Ä€😀", "]]>", " ", "None"]
    users = [*odd, *(f"u{i:03}" for i in range(150))]
    edges = [(a, b, i + 1) for i, a in enumerate(users) for b in users] + [(None, "u001", 7)]
    messages = [(f"m{i}", u, None if i % 3 == 0 else f"n {u}", None if i % 4 == 0 else f"text {u}\n", i) for i, u in enumerate([*users, "alone"])]
    network = spark.createDataFrame(edges, "user_1 string, user_2 string, weight long").repartition(7)
    m = spark.createDataFrame(messages, "message_id string, user_id string, username string, message string, timestamp long")
    rows, kind = [], type(network)
    local = kind.toLocalIterator

    def counted(self, *a, **b):
        for r in local(self, *a, **b):
            rows.append(1)
            yield r

    monkeypatch.setattr(kind, "toLocalIterator", counted)
    monkeypatch.setattr(lines, "PACKED", 1 << 16)
    for loops in (False, True):
        path = tmp_path / f"{loops}.graphml"
        outputs.write_graphml(network, "co_post", m, str(path), loops, 2)
        data = lambda *x: "".join(f'<data key="{k}">{escape(_clean(v))}</data>' for k, v in x if v is not None)
        want = [f"    <node id={quoteattr(_clean(u))}>{data(('n0', n), ('n1', t), ('n2', ''))}</node>\n" for _, u, n, t, _ in sorted(messages, key=lambda r: r[1].encode()) if u != "alone"]
        order = sorted(edges, key=lambda r: tuple((x or "").encode() for x in r[:2]))
        want += [f"    <edge source={quoteattr(_clean(a))} target={quoteattr(_clean(b))}>{data(('e0', w), ('e1', 'co_post'))}</edge>\n" for a, b, w in order if loops or a not in (b, None)]
        text = path.read_bytes().decode()
        start = text.index('directed">\n') + len('directed">\n')
        assert text[start:] == "".join(want) + "  </graph>\n</graphml>\n"
        assert '<key id="n0" for="node" attr.name="username" attr.type="string"/>' in text[:start]
    assert len(rows) < 600
