"""Readers, the store, links, exports and the command line."""

import csv
import json
import xml.etree.ElementTree as ET

import pytest

from tandem import cli
from tandem.functions import text
from tandem.operators import links, outputs
from tandem.sources import messages
from tandem.sources.store import Store


def column(spark, values, f):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t"))).orderBy("i").collect()]


def test_text(spark):
    given = ["Hello  @bob World", "mail a@b.c now", "", None, "A B　c\x1cd", "@x"]
    assert column(spark, given, text.normalise) == ["hello world", "mail a now", "", None, "a b c d", ""]
    fox = "The quick brown fox jumped over the lazy dog."
    for f in (text.tokens, text.word_tokens):
        assert column(spark, ["hello", fox, "", None], f) == [["hello"], ". brown dog fox jumped lazy over quick the".split(), [], None]
    assert column(spark, ["don't 3.14"], text.tokens) == [["'", ".", "14", "3", "don", "t"]]


def test_similarity(spark):
    q = "select split(a, ' ') as a, split(b, ' ') as b from values ('hello world', 'hello world'), ('hello world', 'world hello'), ('a b c d', 'a b c d') t(a, b)"
    df = spark.sql(q)
    assert [r[0] for r in df.select(text.jaccard(df.a, df.b)).collect()] == [1, 1, 1]
    assert [r[0] for r in df.select(text.jaccard_of_size(5)(df.a, df.b)).collect()] == [0, 0, 0]
    empty = spark.sql("select array() as a, array() as b")
    assert empty.select(text.jaccard(empty.a, empty.b)).first()[0] is None


V1 = {
    "id": 5 << 22, "id_str": str(5 << 22), "user": {"id_str": "7", "screen_name": "seven"}, "text": "short", "extended_tweet": {"full_text": "long", "entities": {"urls": [{"expanded_url": "http://e/1"}]}},
    "entities": {"urls": [{"expanded_url": "http://e/2"}]}, "in_reply_to_status_id_str": "3",
}
V1_REPOST = {"id": 6 << 22, "id_str": str(6 << 22), "user": {"id_str": "8", "screen_name": "eight"}, "full_text": "RT", "retweeted_status": {"id_str": "1"}, "entities": {"urls": [{"expanded_url": "http://e/3"}]}}
V2 = {
    "data": [
        {"id": str(9 << 22), "author_id": "1", "text": "two", "referenced_tweets": [{"type": "quoted", "id": "4"}, {"type": "replied_to", "id": "5"}, {"type": "replied_to", "id": "6"}], "entities": {"urls": [{"expanded_url": "http://e/4"}]}},
        {"id": str(10 << 22), "author_id": "2", "text": "RT", "referenced_tweets": [{"type": "retweeted", "id": "77"}]},
    ],
    "includes": {"users": [{"id": "1", "username": "one"}, {"id": "2", "username": "two"}]},
}
FLAT = {"id": str(11 << 22), "author_id": "3", "author": {"username": "three"}, "text": "flat"}


def test_posts_json(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text("\n".join(map(json.dumps, (V1, V1_REPOST, V2, FLAT))))
    got = {r["user_id"] + r["username"]: r for r in messages.read_posts_json(spark, [str(path)]).collect()}
    assert set(got) == {"7seven", "8eight", "1one", "2two", "3three"}
    assert (got["7seven"]["message"], got["7seven"]["urls"], got["7seven"]["reply_id"], got["7seven"]["timestamp"]) == ("long", ["http://e/1"], "3", 0.005)
    assert (got["8eight"]["repost_id"], got["8eight"]["message"]) == ("1", "RT")
    assert (got["1one"]["reply_id"], got["1one"]["repost_id"], got["1one"]["urls"], got["1one"]["timestamp"]) == ("6", None, ["http://e/4"], 0.009)
    assert (got["2two"]["repost_id"], got["3three"]["urls"]) == ("77", [])
    path.write_text('{"other": 1}')
    with pytest.raises(Exception, match="not a post"):
        messages.read_posts_json(spark, [str(path)]).collect()


def page(path, *ids):
    return json.dumps({"__twarc": {"url": f"https://api/2/{path}?x=1"}, "data": [{"id": i, "username": f"n{i}"} for i in ids]})


def test_likes(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text("\n".join([page("tweets/10/liking_users", "1", "2"), page("tweets/10/liking_users", "3")]))
    b.write_text("\n".join([page("tweets/10/liking_users", "4"), page("tweets/11/liking_users", "1"), page("tweets/10/liking_users", "5")]))
    got = {(r["message_id"], r["timestamp"], r["username"], r["repost_id"]) for r in messages.read_likes_json(spark, [str(a), str(b)]).collect()}
    assert got == {("10_1", 0, "n1", "10"), ("10_2", 1, "n2", "10"), ("10_3", 2, "n3", "10"), ("10_4", 3, "n4", "10"), ("11_1", 0, "n1", "11"), ("10_5", 0, "n5", "10")}
    a.write_text("\n".join([page("users/7/liked_tweets", "1", "2"), page("users/8/liked_tweets", "1")]))
    assert {(r["message_id"], r["timestamp"], r["username"]) for r in messages.read_likes_json(spark, [str(a)]).collect()} == {("1_7", 0, "7"), ("2_7", 0, "7"), ("1_8", 0, "8")}
    profiles = spark.createDataFrame([("7", "seven"), ("8", None)], "user_id string, username string")
    assert {r["username"] for r in messages.read_likes_json(spark, [str(a)], profiles).collect()} == {"seven", "8_profile_unavailable"}
    with pytest.raises(TypeError):
        messages.read_likes_json(spark, [str(a), str(b)])
    b.write_text(page("users/8/followers", "1"))
    with pytest.raises(ValueError, match="only pages"):
        messages.read_likes_json(spark, [str(b)])


def rows(*changes):
    return [("a1", "u1", "n1", "", "", "one", 0, ["http://x/1"]), ("a2", "u2", "n2", None, None, "two", 1, None), *changes]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no messages"):
        Store(spark, path).messages()
    Store(spark, path).append(messages.from_rows(spark, rows()))
    Store(spark, path).append(messages.from_rows(spark, [("a1", "u9", "n9", "", "", "late", 5, ["http://x/2", "http://x/1"]), (7, 8, "n", 0, "0", "number", 2, []), ("a3", None, "n", "", "", "no user", 2, [])]))
    s = Store(spark, path)
    assert {(r["message_id"], r["user_id"], r["reply_id"]) for r in s.messages().collect()} == {("a1", "u1", None), ("a2", "u2", None), ("7", "8", "0")}
    assert {(r["message_id"], r["url"], r["user_id"]) for r in s.message_urls().collect()} == {("a1", "http://x/1", "u1"), ("a1", "http://x/2", "u9")}
    with pytest.raises(ValueError, match="empty store"):
        s.append(messages.from_rows(spark, rows()), only_empty=True)
    with pytest.raises(ValueError, match="resolve_urls"):
        s.resolved_message_urls()
    spark.createDataFrame([("version", "99")], "property string, value string").write.mode("overwrite").parquet(f"{path}/metadata")
    with pytest.raises(ValueError, match="format 99"):
        Store(spark, path)


def test_links(spark):
    urls = spark.createDataFrame([("m1", "http://a", 0.0, "u1"), ("m1", "http://b", 0.0, "u1"), ("m2", "http://bad", 1.0, "u2")], "message_id string, url string, timestamp double, user_id string")
    answer = lambda u: (u, u, True, "Timeout") if "bad" in u else (u, "http://same", True, 200)
    found = links.resolve_pending(urls, None, answer, tasks=2, per_second=0)
    assert {tuple(r) for r in found.collect()} == {("http://a", "http://same", True, "200"), ("http://b", "http://same", True, "200"), ("http://bad", "http://bad", True, "Timeout")}
    known = found.where("url = 'http://a'").cache()
    again = links.resolve_pending(urls, known, lambda u: (u, "new", False, "x"), tasks=2, per_second=0)
    assert {r["resolved_url"] for r in again.collect()} == {"http://same", "new"}
    assert {(r["message_id"], r["resolved_url"]) for r in links.resolved_message_urls(urls, found).collect()} == {("m1", "http://same"), ("m2", "http://bad")}
    assert links.resolve_url("http://127.0.0.1:9/x", timeout=0.5)[1::2] == ("http://127.0.0.1:9/x", "ConnectionError")


def test_exports_and_command_line(spark, tmp_path):
    source, db = tmp_path / "in.csv", str(tmp_path / "db")
    lines = ["a,b,c,d,e,f,g,h"] + [f'm{i},u{i % 3},"n<{i % 3}>",r1,,"text ""{i}"" & more\nline",{i},' for i in range(6)]
    source.write_text("\n".join(lines))
    cli.main([db, "preprocess", str(source)], spark)
    out = tmp_path / "net.graphml"
    cli.main([db, "compute", "co_retweet", "--time_window", "10", "--min_edge_weight", "1", "--output_file", str(out)], spark)
    ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
    tree = ET.parse(out)
    assert len(tree.findall(".//g:node", ns)) == 3 and len(tree.findall(".//g:edge", ns)) == 6
    assert any(d.text == 'text "5" & more\nline' for d in tree.iter("{http://graphml.graphdrawing.org/xmlns}data"))
    cli.main([db, "export_network", str(tmp_path / "e.csv"), "co_retweet", "--output_format", "csv", "--include_self_loops"], spark)
    got = list(csv.reader((tmp_path / "e.csv").open(newline="")))
    assert got[0] == ["source", "target", "weight", "edge_type"] and len(got) == 10 and got[1] == ["u0", "u0", "2", "co_retweet"]
    cli.main([db, "export_user_nodes", str(tmp_path / "n.csv"), "--n_messages", "3"], spark)
    got = list(csv.reader((tmp_path / "n.csv").open(newline="")))
    assert got[0] == ["Id", "username", "message_0", "message_1", "message_2"] and got[1] == ["u0", "n<0>", 'text "3" & more\nline', 'text "0" & more\nline', ""]
    for kind in ("co_tweet", "co_reply", "co_link", "co_similar_tweet", "co_post"):
        cli.main([db, "compute", kind, "--time_window", "10"], spark)
    with pytest.raises(ValueError, match="csv or graphml"):
        outputs.write_output(None, "co_post", None, "x", "other")


def test_each_url_is_asked_once(spark, tmp_path):
    from tandem.operators import links

    def resolver(url):
        with open(tmp_path / "asked", "a") as f:
            f.write(url + "\n")
        return url, url + "/x", True, "200"

    urls = spark.createDataFrame([(u,) for u in ("a", "b", "c")], "url string")
    old = links.resolve_pending(urls.where("url = 'c'"), None, lambda u: (u, "old", True, "200"), tasks=2, per_second=0)
    old = spark.createDataFrame(old.toPandas(), old.schema)
    found = {r["url"]: r["resolved_url"] for r in links.resolve_pending(urls, old, resolver, tasks=2, per_second=0).collect()}
    assert found == {"a": "a/x", "b": "b/x", "c": "old"} and sorted((tmp_path / "asked").read_text().split()) == ["a", "b"]


def test_stored_tables_leave_settings_and_can_go(spark):
    import os

    from pyspark.sql import functions as F

    from tandem.sources import shared

    before = spark.conf.get(shared._CLEANUP, None)
    table = shared.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert spark.conf.get(shared._CLEANUP, None) == before and table.count() == 7
    path = table._tandem_path.removeprefix("file://")
    assert os.path.exists(path)
    shared.forget(table)
    assert not os.path.exists(path)


def test_pages_users_stay_with_the_page(spark, tmp_path):
    """Names come from the page's first user of the id, else from the post; no post carries its page's users along."""
    import json

    from tandem.sources import messages

    post = lambda i, a, **more: {"id": str(i << 22), "author_id": a, "text": f"t{i}", **more}
    pages = [
        {"data": [post(1, "a"), post(2, "b"), post(3, "c", author={"username": "own"}), post(4, "d", author={"username": "own"})], "includes": {"users": [{"id": "a", "username": "first"}, {"id": "a", "username": "second"}, {"id": "c", "username": None}, {"username": "nobody"}]}},
        {"data": [post(5, "a"), post(6, "e", author={"username": "e6"})]},
        post(7, "a", author={"username": "flat"}),
        {"data": [post(10 + i, f"u{i}") for i in range(500)], "includes": {"users": [{"id": f"u{i}", "username": f"n{i}"} for i in range(500)]}},
    ]
    path = tmp_path / "pages.json"
    path.write_text("\n".join(map(json.dumps, pages)))
    found = messages.read_posts_json(spark, [str(path)])
    got = {int(r["message_id"]) >> 22: r["username"] for r in found.collect()}
    assert got == {1: "first", 2: None, 3: "own", 4: "own", 5: None, 6: "e6", 7: "flat"} | {10 + i: f"n{i}" for i in range(500)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[plan.rindex("Union") : plan.rindex("Generate posexplode")]
    assert "includes" not in above and "users" not in above
