"""Typed topics against a plain walk over rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from statuta.functions import references as r
from statuta.operators import topics

DDL = "path string, pos int, title string, type_of_content string, heading_stack array<string>, has_text boolean"


def walked(rows, told, default):
    """told: raw title -> (type, code, title, {type: reference}) as the column functions give them."""
    app = lambda t: t.strip().upper().startswith(("APPENDIX ", "APPENDIX "))
    names = lambda t: re.search(r"\bto\s+(?:AMC|GM|CS)\b", t, re.I)
    nodes, seen = [], set()
    for _, pos, title, said, stack, text in rows:
        kind, code, clean, refs = told[title]
        if kind is None:
            continue
        if kind == default and said and said.upper() in topics.TYPES:
            kind = said.upper()
        if app(title) and kind == default:
            above = " ".join(stack).upper()
            kind = "GM" if "GM" in (said or "").upper() or "GM" in above else "AMC"
        if text and (kind, refs[kind]) not in seen:
            seen.add((kind, refs[kind]))
            nodes.append([pos, kind, refs[kind], clean])
    by_ref = {n[2]: n for n in nodes}
    for i, (_, _, title, _, stack, _) in enumerate(rows):
        kind, code, _, refs = told[title]
        if not app(title) or names(title) or kind is None or refs[kind] not in by_ref:
            continue
        for _, _, before, _, above, _ in reversed(rows[:i]):
            k, c, _, rf = told[before]
            if above != stack or (app(before) and not names(before)) or k is None or re.search(topics.OLD_CODE, c):
                continue
            node = by_ref.pop(refs[kind])
            m = re.match(r"^(Appendix\s+\S+)(.*)", node[2], re.I | re.S)
            node[2] = f"{m[1]} to {rf[k]}{m[2]}" if m else node[2]
            break
    notes = {n[2] for n in nodes if n[1] in ("AMC", "GM") and re.match(r"^Appendix\b", n[2], re.I)}
    return {tuple(n) for n in nodes if not (n[1] == "CS" and re.match(r"^Appendix\b", n[2], re.I) and n[2] in notes)}


TITLES = ["CS 25.101 General", "AMC 25.101 Means", "AMC2 25.103 More", "GM1 25.105 Guide", "25.107 Bare", "21.A.15 Rule", "Appendix 1 – Methods", "Appendix 2 – Tables", "Appendix 3 Space", "Appendix A to GM 25.101 Own", "APPENDIX 1 – Methods", "CS 25J901 Old", "no code here", "Appendix F"]


@pytest.mark.parametrize("default", ["CS", "IR"])
def test_topics_by_a_walk(spark, default):
    rng = random.Random(21)
    docs = {}
    for d in range(14):
        docs[f"d{d}"] = [(f"d{d}", p, rng.choice(TITLES), rng.choice([None, None, "AMC", "gm", "IR", "CS", "AMC/GM", ""]), rng.choice([["SUBPART A"], ["SUBPART B"], ["AMC SUBPART A"], ["GM"]]), rng.random() > 0.15) for p in range(16)]
    rows = [x for rs in docs.values() for x in rs]
    t = F.col("t")
    c = r.classified(t, default)
    told = {x["t"]: (x["c"]["node_type"], x["c"]["code"], x["c"]["title"], {k: x[k] for k in topics.TYPES}) for x in spark.createDataFrame([(x,) for x in TITLES], "t string").withColumn("c", c).select("t", "c", *[r.reference_code(F.lit(k), F.col("c.code"), t).alias(k) for k in topics.TYPES]).collect()}
    got = {(x["doc"], x["pos"], x["node_type"], x["reference_code"], x["title"]) for x in topics.typed_topics(spark.createDataFrame(rows, DDL).repartition(5), default, rows=5).collect()}
    assert got == {(d, *n) for d, rs in docs.items() for n in walked(rs, told, default)}
    assert any(" to " in x[3] and x[3].startswith("Appendix 1") for x in got)
    assert topics.typed_topics(spark.createDataFrame([], DDL), default).count() == 0
