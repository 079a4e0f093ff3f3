"""License scans by ordered signature rules, in DataFrame functions only.

A text's words (lower-cased in A-Z, joined by single blanks) are searched for rules: regular expressions, each with a
label, a priority and keywords, of which its matches hold one. Texts without any keyword are passed over after a substring
search; in the others, only rules of which a keyword occurs are tried. Of overlapping detections the higher priority stays,
and of equal priority the one that contains the other.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The words of a text before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count by themselves, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_L = "licen[cs]es?"
#: label, keywords (any match holds one of them), how the license is called, how machine-readable lines call it. Words are those of a text, so a version
#: such as 2.0 is "2 0". Longer names stand for themselves; what may follow a name is part of it.
LICENSES = [
    ("mit", "mit|expat", rf"(?:mit|expat|mit x11|mit expat)(?: style)? {_L}", "mit"),
    ("mit-0", "mit", rf"mit no attribution(?: {_L})?", "mit 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? {_L} (?:version |v )?1 1", "apache 1 1"),
    ("apache-2", "apache", rf"apache(?: software)? {_L} (?:version |v )?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", rf"apache(?: software)? {_L}", "apache"),
    ("bsd-2-clause", "bsd", rf"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {_L})?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", rf"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {_L})?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", rf"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {_L})?", "bsd 4 clause"),
    ("0bsd", "bsd", rf"(?:zero clause bsd|bsd zero clause|0bsd)(?: {_L})?", "0bsd"),
    ("bsd", "bsd", rf"bsd(?: style)? {_L}", "bsd"),
    ("gpl-1", "gpl", r"(?:gnu )?gpl ?(?:version |v)1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?(?: only| or later)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-2", "general public", rf"gnu general public {_L} (?:version |v )?2(?: 0)?(?: only| or later| or any later version)?", "gnu gpl 2"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?(?: only| or later)?", "gpl 3 0(?: only| or later)?"),
    ("gpl-3", "general public", rf"gnu general public {_L} (?:version |v )?3(?: 0)?(?: only| or later| or any later version)?", "gnu gpl 3"),
    ("gpl", "general public", rf"gnu general public {_L}", "gnu gpl"),
    ("gpl", "gpl", rf"(?:gnu )?gpl {_L}", "gpl"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?2 1(?: only| or later)?", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", rf"(?:gnu )?lesser general public {_L} (?:version |v )?2 1(?: only| or later)?", "gnu lgpl 2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?(?: only| or later)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-3", "lesser general", rf"(?:gnu )?lesser general public {_L} (?:version |v )?3(?: 0)?(?: only| or later)?", "gnu lgpl 3"),
    ("lgpl", "lesser general|library general", rf"(?:gnu )?(?:lesser|library) general public {_L}", "gnu lgpl"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?(?: only| or later)?", "agpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero", rf"(?:gnu )?affero general public {_L}(?: (?:version |v )?3(?: 0)?)?(?: only| or later)?", "gnu agpl 3"),
    ("gfdl", "documentation", rf"gnu free documentation {_L}(?: version 1 [0-3])?", "gfdl 1 [0-3](?: only| or later)?"),
    ("mpl-1.1", "mpl", r"mpl ?(?:version |v)?1 1", "mpl 1 1"),
    ("mpl-1.1", "mozilla", rf"mozilla public {_L} (?:version |v )?1 1", "mozilla 1 1"),
    ("mpl-2", "mpl", r"mpl ?(?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("mpl-2", "mozilla", rf"mozilla public {_L} (?:version |v )?2(?: 0)?", "mozilla 2 0"),
    ("mpl", "mozilla", rf"mozilla public {_L}", "mozilla"),
    ("epl-1", "eclipse", rf"eclipse public {_L} (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", rf"eclipse public {_L} (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", rf"eclipse (?:public|distribution) {_L}", "epl"),
    ("cddl", "cddl", r"cddl(?: (?:version |v )?1 [01])?", "cddl 1 [01]"),
    ("cddl", "common development", rf"common development and distribution {_L}(?: version 1 [01])?", "cddl"),
    ("cpl-1", "common public", rf"common public {_L}(?: version)? ?(?:1 0)?", "cpl 1 0"),
    ("eupl", "eupl", r"eupl(?: (?:version |v )?1 [0-2])?", "eupl 1 [0-2]"),
    ("eupl", "european union", rf"european union public {_L}", "eupl"),
    ("isc", "isc", rf"isc {_L}", "isc"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_L}", "zlib"),
    ("bsl-1", "boost", rf"boost software {_L}(?: (?:version |v )?1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", "wtfpl"),
    ("artistic-1", "artistic", rf"artistic {_L} (?:version |v )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2", "artistic", rf"artistic {_L} (?:version |v )?2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", rf"artistic {_L}", "artistic"),
    ("perl", "perl", r"same terms as perl(?: itself)?", "perl"),
    ("python-2", "python|psf", rf"(?:python software foundation|psf|python) {_L}(?: version 2)?", "(?:python|psf) 2 0"),
    ("php-3", "php", rf"php {_L}(?: version)? ?(?:3 0(?:1)?)?", "php 3 01?"),
    ("ruby", "ruby", rf"ruby {_L}", "ruby"),
    ("openssl", "openssl", rf"openssl {_L}", "openssl"),
    ("postgresql", "postgresql", rf"postgresql {_L}", "postgresql"),
    ("ms-pl", "microsoft", rf"microsoft public {_L}", "ms pl"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {_L}", "ms rl"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font {_L}(?: version)? ?(?:1 [01])?", "ofl 1 1"),
    ("odbl", "open database|commons database", rf"open (?:data commons )?(?:open )?database {_L}(?: (?:version |v )?1 0)?", "odbl 1 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", "creative commons by nc nd"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "creative commons by nc sa"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?", "creative commons by nc"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", "creative commons by nd"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?", "creative commons by sa"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?", "cc by [1-4] [05]"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?", "creative commons by"),
    ("creative-commons", "creative commons", rf"creative commons {_L}", "creative commons"),
    ("public-domain", "public domain", r"public domain(?: dedication)?", "public domain"),
    ("proprietary", "rights reserved", r"all rights reserved", "proprietary"),
]
_GRANT = "(?:licen[cs]ed|released|distributed|published|available|provided|shared|redistributed|offered|used|made available)"
#: priority and form of a rule; NAME and ID stand for a license's two names.
FORMS = [
    (90, " spdx licen[cs]e identifier ID"),
    (80, f" {_GRANT}(?: to you| and distributed)? under(?: the)?(?: terms(?: and conditions)? of(?: the)?)?(?: a| an)? NAME"),
    (70, " (?:subject to|according to|in accordance with|governed by|covered by|compliance with)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? NAME"),
    (60, r" licen[cs]e(?: is| type)?(?: the)? NAME"),
    (50, " (?:see|read|consult|refer to)(?: the)? NAME(?: for(?: more)? (?:details|information))?"),
    (40, " NAME"),
]
#: Any match holds one of these in its lower-cased words.
KEYWORDS = ("licen", "cc", "gpl", "apache", "bsd", "mpl", "cddl", "eupl", "wtfpl", "perl", "creative", "domain", "reserved", "attribution")


def rules() -> list[dict]:
    """All rules in order: each form for each license. A match ends before a blank and begins with one."""
    out = []
    for priority, form in FORMS:
        for label, keywords, name, machine in LICENSES:
            regex = form.replace("NAME", f"(?:{name})").replace("ID", f"(?:{machine})") + "(?= )"
            out.append({"rule": len(out), "label": label, "priority": priority, "keywords": ("spdx",) if "spdx" in form else tuple(keywords.split("|")), "regex": regex})
    return out


def _words_in(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(words: Column, regex: Column, length: Column | None = None) -> Column:
    """(first, last) word of each match, in order: a match begins with the blank before its first word, so that blanks
    count words; what lies between matches comes from splitting at them."""
    found, between = F.regexp_extract_all(words, regex, F.lit(0)), F.split(words, regex, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first: int, last: int>>").alias("found"))

    def step(s: Column, i: Column) -> Column:
        first = s["at"] + _words_in(F.get(between, i))
        after = first + _words_in(F.get(found, i))
        return F.struct(after.alias("at"), F.concat(s["found"], F.array(F.struct(first.alias("first"), (after - 1).alias("last")))).alias("found"))

    n = F.size(found)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda s: s["found"])).otherwise(zero["found"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, base and detections of each row of docs, whose texts count whole.

    base: (label, first, last) of each place of a phrase of BASE; detections: (rule, label, priority, first, last) of what
    the rules leave; places in words from 0. Null texts count as empty; texts without keywords have empty arrays. Rows
    repeat as in docs; an empty table gives no rows.
    """
    need(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text.alias("text"))
    small = F.lower("text")
    keyed = F.lit(False)
    for k in KEYWORDS:
        keyed = keyed | F.contains(F.col("low"), F.lit(k))
    x = x.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long")).withColumn("low", small).withColumn("keyed", keyed)
    plain = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), BREAK, " "))
    x = x.withColumn("words", F.when(F.col("keyed"), F.concat(F.lit(" "), plain, F.lit(" ")))).drop("low", "keyed", "text")

    words = F.col("words")
    none = "array<struct<label: string, first: int, last: int>>"

    def phrase_places(phrase: str, label: str) -> Column:
        return F.transform(_places(words, F.lit(f" {phrase}(?= )")), lambda p: F.struct(F.lit(label).alias("label"), p["first"].alias("first"), p["last"].alias("last")))

    base = F.concat(*[phrase_places(*x) for x in BASE.items()])
    x = x.withColumn("base", F.when(words.isNotNull(), base).otherwise(F.array().cast(none)))

    groups: dict[tuple[str, ...], list[dict]] = {}
    for r in rules():
        groups.setdefault(r["keywords"], []).append(r)
    listed = json.dumps([{"keywords": k, "rules": [{n: r[n] for n in ("rule", "label", "priority", "regex")} for r in rs]} for k, rs in groups.items()])
    literal = F.from_json(F.lit(listed), "array<struct<keywords: array<string>, rules: array<struct<rule: int, label: string, priority: int, regex: string>>>>")
    tried = F.flatten(F.transform(F.filter(literal, lambda g: F.exists(g["keywords"], lambda k: F.contains(words, k))), lambda g: g["rules"]))
    of_rule = lambda r: F.transform(_places(words, r["regex"]), lambda p: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), p["first"].alias("first"), p["last"].alias("last")))
    kind = "array<struct<rule: int, label: string, priority: int, first: int, last: int>>"
    x = x.withColumn("all", F.when(words.isNotNull(), F.flatten(F.transform(tried, of_rule))).otherwise(F.array().cast(kind)))

    def beaten(d: Column, e: Column) -> Column:
        overlap = (e["first"] <= d["last"]) & (d["first"] <= e["last"])
        contains = (e["first"] <= d["first"]) & (e["last"] >= d["last"])
        longer = contains & ((e["last"] - e["first"]) > (d["last"] - d["first"]))
        same = (e["first"] == d["first"]) & (e["last"] == d["last"]) & (e["rule"] < d["rule"])
        return overlap & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer | same)))

    kept = F.filter("all", lambda d: ~F.exists("all", lambda e: beaten(d, e)))
    return x.select("doc_id", "text_hash", "n_words", "base", kept.alias("detections"))
