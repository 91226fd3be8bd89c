"""License scan by ordered signature rules, in DataFrame functions only.

A text is reduced to its words (runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased),
single spaces between them. Of each rule's regex the keywords are derived of which every match contains one; a text must
contain one of them before the regex runs; rules whose keywords hold the same few words are a family, which a text must contain
one of, and one of all families' words (gate_keywords) before any is tried. A detection is a range of words. Detections are ordered by start, the longer first, then by tier (1 is strongest) and
by the order of the rules; one that lies inside another of the same or a stronger tier is suppressed. Base phrases are rules
too, and are never suppressed. The scan needs no shuffle. The rules are one constant array of the plan (a column for each of
hundreds of regexes would take a minute to plan); a regex is compiled for a text only if that holds one of its keywords.

Defined cases: a null or empty text has no words, no labels and score 0; a long text is scanned whole, in time that grows little
faster than its length and its detections; equal detections of several rules are all reported, and the first of them by the
order above is kept; rows may repeat; columns of any names are kept, except that n_words and detections are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bound, masked, running
from .license_rules import rules as written_rules

#: Phrases whose places are always reported, and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words that stand for longer keywords in the gate.
GATE = ["licen", "public domain", "creative", "cc by", "apache", "gpl", "bsd", "copyright", "copies", "reserv", "warrant", "permission", "permitted", "confidential", "reproduc", "prohibited", "commercial", "source code", "free software"]


def alternatives(regex: str) -> list[str]:
    """The parts between the outermost bars."""
    out, depth = [""], 0
    for c in regex:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def mandatory(regex: str) -> list[str]:
    """Strings of which every match of the regex, with a space before and after it, contains one; of all choices one that GATE
    covers, then that with the most letters."""

    def worth(choice: set[str]) -> tuple:
        return all(any(g in k for g in GATE) for k in choice), min(sum(c.isalpha() for c in k) for k in choice), min(map(len, choice)), -len(choice)

    def of(items) -> set[str]:
        choices, run = [], ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            choices.append({run})
            run = ""
            if name == "SUBPATTERN":
                choices.append(of(arg[3]))
            elif name == "BRANCH":
                choices.append(set().union(*map(of, arg[1])))
            elif name == "MAX_REPEAT" and arg[0] > 0:
                choices.append(of(arg[2]))
        return max([*choices, {run}], key=worth)

    parser = re._parser  # the standard library has no other parser of regexes
    found = set().union(*(of(parser.parse(f" {part} ")) for part in alternatives(regex)))
    return sorted(k for k in found if not any(x != k and x in k for x in found))


@functools.cache
def rules() -> list[dict]:
    """The rules, base phrases first. keywords: a text must contain one of them for the regex to be tried."""
    rows = [(3, 0.6, label, phrase, True) for phrase, label in BASE.items()] + [(*r, False) for r in written_rules()]
    return [{"id": i, "label": label, "keywords": mandatory(regex), "regex": f"(?<![^ ])(?:{regex})(?![^ ])", "tier": tier, "confidence": confidence, "base": base} for i, (tier, confidence, label, regex, base) in enumerate(rows)]


def _gate(keyword: str) -> str:
    return next((g for g in GATE if g in keyword), keyword)


@functools.cache
def families() -> list[dict]:
    """The rules by gate: what a text must contain one of for any rule of the family to be tried."""
    out: dict[tuple, list[dict]] = {}
    for r in rules():
        out.setdefault(tuple(sorted({_gate(k) for k in r["keywords"]})), []).append(r)
    return [{"gate": list(gate), "rules": of} for gate, of in out.items()]


@functools.cache
def gate_keywords() -> list[str]:
    """A text without any of these needs no rule: the gates of all families, but those that contain another."""
    every = {k for f in families() for k in f["gate"]}
    return sorted(k for k in every if not any(x != k and x in k for x in every))


def words_text(text: Column) -> Column:
    """The words with single spaces between them."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


RULE = "struct<id:int,label:string,keywords:array<string>,regex:string,tier:int,confidence:double,base:boolean>"


def _found(words: Column, rule: Column) -> Column:
    """The detections of one rule: a mark before each match tells the word at which it starts."""
    marked = F.split(F.regexp_replace(words, rule["regex"], F.lit("\x01$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.substring(w, 1, 1) == "\x01", i)), lambda i: i.isNotNull())
    sizes = F.transform(F.regexp_extract_all(words, rule["regex"], F.lit(0)), lambda m: F.size(F.split(m, " ")))
    return F.zip_with(starts, sizes, lambda start, n: F.struct(start.alias("start"), (-(start + n)).alias("minus_end"), rule["tier"].alias("tier"), rule["id"].alias("rule")))


def _resolved(found: Column, table: Column) -> Column:
    """Marks what is kept: what reaches beyond all detections before it of its tier or a stronger one."""

    def shown(d, reach, i):
        end, rule = -d["minus_end"], F.get(table, d["rule"])
        kept = F.get(F.get(reach, d["tier"] - 1), i) < end
        return F.struct(d["start"].alias("start"), end.alias("end"), rule["label"].alias("label"), d["rule"].alias("rule"), d["tier"].alias("tier"),
                        rule["confidence"].alias("confidence"), rule["base"].alias("base"), (kept | rule["base"]).alias("kept"))

    def resolved(rows):
        ends = lambda tier: F.transform(rows, lambda d: F.when(d["tier"] <= tier, -d["minus_end"]).otherwise(0).cast("long"))
        reach = F.transform(F.array(*(F.lit(t) for t in (1, 2, 3))), lambda tier: running(ends(tier), highest=True))
        return bound(reach, lambda r: F.transform(rows, lambda d, i: shown(d, r, i)))

    return bound(F.array_sort(found), resolved)


KIND = "array<struct<start:int,end:int,label:string,rule:int,tier:int,confidence:double,base:boolean,kept:boolean>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words and detections: array of start, end (words, end exclusive), label, rule, tier, confidence, base, kept."""
    rows, names = masked(docs.drop("n_words", "detections"))
    words, padded = F.col("_words"), F.col("_padded")
    table = F.from_json(F.lit(json.dumps(rules())), f"array<{RULE}>")
    grouped = F.from_json(F.lit(json.dumps(families())), f"array<struct<gate:array<string>,rules:array<{RULE}>>>")
    out = rows.withColumn("_words", words_text(F.col(names[text]))).withColumn("_padded", F.concat(F.lit(" "), words, F.lit(" ")))
    gaps = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
    gate = functools.reduce(lambda a, b: a | b, (padded.contains(k) for k in gate_keywords()))
    some = lambda keys: F.exists(keys, lambda k: padded.contains(k))
    open_ = F.flatten(F.transform(F.filter(grouped, lambda f: some(f["gate"])), lambda f: f["rules"]))
    tried = F.filter(open_, lambda r: some(r["keywords"]) & F.rlike(words, r["regex"]))
    found = F.flatten(F.transform(tried, lambda r: _found(words, r)))
    out = out.withColumns({
        "_n_words": F.when(words == "", 0).otherwise(gaps + 1).cast("long"),
        "_detections": F.when(gate, _resolved(found, table)).otherwise(F.array().cast(KIND)),
    })
    # a select of its own: columns of docs may have the names used above
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("_n_words").alias("n_words"), F.col("_detections").alias("detections"))
