"""Secret scan over a trigram inverted index, in DataFrame functions only.

For each rule's regex a Boolean query over trigrams of lower-cased (A-Z) text is derived: all of some groups must hold, a
group holds if one of its alternatives does, an alternative is a set of trigrams that must all occur.

Index: rows get slots by a hash of id and text, 64 slots are a block, and the posting of a trigram in a block is a bitmap of
slots: (block, trigram, rows) in a written table, for the trigrams that any query names. A query intersects (and unites) the
postings of its trigrams, block by block, which gives the candidate slots of each rule; rows that share a slot are all
candidates. Only texts of candidate slots are shuffled, to be verified by the regex. Rules whose regex has no mandatory trigram
scan every text where it stands.

Defined cases: a null text is empty; a long text is scanned whole, in time that grows little faster than its length and its
spans; rows that repeat with the same id and text share their spans; a null id is a value like others; spans are code points,
end exclusive, sorted by start and then by the order of the rules; columns of any names are kept, except that a column spans is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, likely, masked, running, written

#: kind, regex, the group whose length counts, its least length. The first three are the base rules. For `hex` and `access`
#: a match shorter than the least length is a whole run, so the length may stand in the regex; for `assign` it may not.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("aws_session", r"ASIA[A-Z0-9]{16}", 0, 20),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("github_fine", r"github_pat_[A-Za-z0-9_]{22,}", 0, 33),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 26),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", 0, 40),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}", 0, 24),
    ("npm", r"npm_[A-Za-z0-9]{36}", 0, 40),
    ("pypi", r"pypi-AgEI[A-Za-z0-9_-]{50,}", 0, 59),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, 69),
    ("hugging_face", r"hf_[A-Za-z0-9]{30,}", 0, 33),
    ("shopify", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}", 0, 38),
    ("ocean", r"do[opr]_v1_[a-f0-9]{64}", 0, 71),
    ("square", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}", 0, 29),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("private_key", r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY(?: BLOCK)?-----", 0, 27),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}", 0, 27),
    ("basic_url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"']{1,80}:[^\s/:@\"']{3,80}@[A-Za-z0-9.-]+", 0, 10),
    ("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}", 0, 74),
    ("mail_key", r"key-[0-9a-f]{32}", 0, 36),
    ("twilio", r"(?:SK|AC)[0-9a-f]{32}", 0, 34),
]
BASE = ("assign", "access", "hex")
FREQUENT = "etaoinsrhldcumfpgwybv"  # letters from the most frequent on; others are rare


def _rare(trigram: str) -> int:
    return sum(FREQUENT.find(c) if c in FREQUENT else 30 for c in trigram)


def trigram_query(regex: str, most: int = 3) -> list[list[list[str]]]:
    """All of the groups must hold, a group is a list of alternatives, an alternative a list of trigrams (the `most` rarest).
    An empty list: the regex has no mandatory trigram."""
    parser = re._parser  # the standard library has no other parser of regexes
    groups: list[list[list[str]]] = []

    def cross(a: set[str], b: set[str]) -> set[str]:
        return {x + y for x, y in product(a, b)}

    def flush(strings: set[str]) -> set[str]:
        if min(map(len, strings)) >= 3:
            groups.append([sorted(sorted({s[i : i + 3] for i in range(len(s) - 2)}, key=lambda t: (-_rare(t), t))[:most]) for s in sorted(strings)])
        return {""}

    def exact(items) -> set[str] | None:
        """All strings (lower-cased) that the items can match, if these are few."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                got = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                got = {chr(a).lower() for _, a in arg}
            elif name == "BRANCH":
                parts = [exact(x) for x in arg[1]]
                got = set().union(*parts) if None not in parts else None
            elif name == "SUBPATTERN":
                got = exact(arg[3])
            elif name == "MAX_REPEAT" and arg[1] == 1:
                got = exact(arg[2])
                got = got and ({""} | got if arg[0] == 0 else got)
            elif name == "MAX_REPEAT" and arg[0] == arg[1] <= 8:
                one, got = exact(arg[2]), {""}
                for _ in range(arg[0]):
                    got = one and cross(got, one)
            else:
                got = None
            out = got and cross(out, got)
            if not out or len(out) > 64:
                return None
        return out

    def walk(items) -> None:
        strings = {""}
        for item in items:
            got = exact([item])
            if got and len(strings) * len(got) <= 64:
                strings = cross(strings, got)
                continue
            strings = flush(strings)
            if got:
                strings = got
            elif str(item[0]) == "SUBPATTERN":
                walk(item[1][3])
            elif str(item[0]) == "MAX_REPEAT" and item[1][0] > 0:
                walk(item[1][2])
        flush(strings)

    walk(parser.parse(regex))
    return groups


def queries(rules=RULES) -> list[dict]:
    return [{"place": i, "kind": kind, "regex": regex, "part": part, "least": least, "query": trigram_query(regex)} for i, (kind, regex, part, least) in enumerate(rules)]


def trigrams(rules=RULES) -> list[str]:
    return sorted({t for r in queries(rules) for group in r["query"] for alternative in group for t in alternative})


def with_slots(docs: DataFrame, slots: int, id: str, text: str) -> DataFrame:
    """docs with _key and _key2 (hashes of id and text, 128 bits) and _slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"_key": F.xxhash64(F.col(id), body), "_key2": F.xxhash64(F.lit(1), body, F.col(id))})
    return out.withColumn("_slot", F.pmod(F.col("_key"), F.lit(slots)))


def postings(slotted: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """(block, trigram, rows): the index."""
    low = slotted.select("_slot", ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    there = F.array(*(F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams(rules)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_slot") % 64).cast("int"))
    each = low.select(F.floor(F.col("_slot") / 64).alias("block"), bit.alias("bit"), F.explode(F.array_compact(there)).alias("trigram"))
    return each.groupBy("block", "trigram").agg(F.bit_or("bit").alias("rows"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(slot, kinds): the rules whose queries hold. A block has no more postings than there are trigrams in queries."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    posting = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), F.lit(0).cast("long"))
    all_of = lambda xs: functools.reduce(lambda a, b: a.bitwiseAND(b), xs)
    any_of = lambda xs: functools.reduce(lambda a, b: a.bitwiseOR(b), xs)
    hits = [F.struct(F.lit(r["kind"]).alias("kind"), all_of(any_of(all_of(map(posting, alternative)) for alternative in group) for group in r["query"]).alias("rows")) for r in queries(rules) if r["query"]]
    blocks = blocks.select("block", F.filter(F.array(*hits), lambda h: h["rows"] != 0).alias("hits")).filter(F.size("hits") > 0)
    in_slot = lambda h, i: F.call_function("shiftright", h["rows"], i).bitwiseAND(F.lit(1).cast("long")) == 1
    kinds = lambda i: F.transform(F.filter("hits", lambda h: in_slot(h, i)), lambda h: h["kind"])
    slots = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct((F.col("block") * 64 + i).alias("slot"), kinds(i).alias("kinds")))
    return blocks.select(F.inline(F.filter(slots, lambda s: F.size(s["kinds"]) > 0)))


SPANS = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"


TABLE = "array<struct<place:int,kind:string,regex:string,part:int,least:int>>"


def _spans(text: Column, rule: Column) -> Column:
    """Start and end of each match whose part is long enough: the pieces between matches give the places."""
    matches, parts = F.regexp_extract_all(text, rule["regex"], F.lit(0)), F.regexp_extract_all(text, rule["regex"], rule["part"])
    long = lambda c: F.char_length(c).cast("long")
    sizes = F.zip_with(matches, parts, lambda m, p: F.struct(long(m).alias("match"), long(p).alias("part")))
    rows = F.zip_with(F.slice(F.split(text, rule["regex"], -1), 1, F.size(matches)), sizes, lambda gap, x: F.struct(long(gap).alias("gap"), x["match"].alias("match"), x["part"].alias("part")))

    def placed(xs):
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), rule["place"].alias("place"), (at + x["gap"] + x["match"]).alias("end"), rule["kind"].alias("kind"), x["part"].alias("part"))
        every = F.zip_with(xs, running(F.transform(xs, lambda x: x["gap"] + x["match"])), span)
        return F.transform(F.filter(every, lambda s: s["part"] >= rule["least"]), lambda s: F.struct(s["start"], s["place"], s["end"], s["kind"]))

    return bound(rows, placed)


def _found(text: Column, rules: list[dict], chosen=lambda kind: F.lit(True)) -> Column:
    """The spans of those rules whose kind is chosen. A regex is compiled for a text only if its rule is chosen for it."""
    table = F.from_json(F.lit(json.dumps(rules)), TABLE)
    tried = F.filter(table, lambda r: chosen(r["kind"]) & F.rlike(text, r["regex"]))
    return F.flatten(F.transform(tried, lambda r: _spans(text, r))).cast(SPANS)


def scan(docs: DataFrame, rules=RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with spans: array of start, end, kind."""
    rows, names = masked(docs.drop("spans"))
    id, text = names[id], names[text]
    table, body, none = queries(rules), F.coalesce(F.col(text), F.lit("")), F.array().cast(SPANS)
    slotted = with_slots(rows, 64 * max(1, -(-docs.count() // 64)), id, text)
    found = written(candidates(written(postings(slotted, rules, text), "postings"), rules), "candidates")
    near = likely(slotted.select("_key", "_key2", "_slot", body.alias("_body")), found.select(F.col("slot").alias("rep")), "_slot")
    some = _found(F.col("_body"), [r for r in table if r["query"]], lambda kind: F.array_contains("kinds", kind))
    verified = near.join(found, F.col("_slot") == F.col("slot")).select("_key", "_key2", some.alias("_some"))
    verified = verified.filter(F.size("_some") > 0).groupBy("_key", "_key2").agg(F.any_value("_some").alias("_some"))
    out = slotted.withColumn("_full", _found(body, [r for r in table if not r["query"]])).join(verified, ["_key", "_key2"], "left")
    every = F.array_sort(F.concat("_full", F.coalesce("_some", none)))
    spans = F.transform(every, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind")))
    out = out.withColumn("_spans", spans)  # a select of its own: columns of docs may have the names used above
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("_spans").alias("spans"))
