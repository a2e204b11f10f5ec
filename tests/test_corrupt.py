"""Corruption: repair slots lead back to the source text."""

import random

from pyspark.sql import functions as F

from repairmine.operators import corrupt as M


def plan_of(r, n):
    """A seeded plan: at most one change or delete a position, any inserts."""
    plan, taken = [], set()
    for draw in range(1, r.randint(1, 7)):
        act = r.choice((1, 3, 4))
        pos = r.randint(0, n if act == 1 else n - 1)
        if act != 1:
            if pos in taken:
                continue
            taken.add(pos)
        plan.append((draw, act, pos, "" if act == 1 else f"t{pos}", "" if act == 3 else f"n{draw}"))
    return plan


def repaired(new, slots):
    """Take back what every slot of the new text names (listed from the right)."""
    out = []
    for i in range(len(new) + 1):
        token = [new[i - 1]] if i else []
        after = []
        for a in (x for x in slots.get(i, "").split(";") if x):
            kind, value = a.split(":")
            if kind == "2":
                after.insert(0, value)
            else:
                token = [value] if kind == "4" else []
        out += token + after
    return out


def test_repair_slots_give_back_the_source(spark):
    r = random.Random(12)
    texts = [[f"t{p}" for p in range(r.randint(1, 12))] for _ in range(120)]
    plans = [plan_of(r, len(t)) for t in texts]
    rows = [(i, t, [dict(zip(("draw", "act", "pos", "frm", "to"), e)) for e in p]) for i, (t, p) in enumerate(zip(texts, plans))]
    df = spark.createDataFrame(rows, "doc long, toks array<string>, "
                                     "plan array<struct<draw:int,act:int,pos:int,frm:string,to:string>>")
    new = {x["doc"]: x["n"] for x in M.with_applied(df, "toks", "plan", "n").collect()}
    slots = {}
    for x in M.repair_slots(df, "doc", "toks", "plan").collect():
        slots.setdefault(x["doc"], {})[x["slot"]] = x["actions"]
    for i, (text, plan) in enumerate(zip(texts, plans)):
        kept = [f"t{p}" for p in range(len(text)) if not any(e[1] != 1 and e[2] == p for e in plan)]
        assert [t for t in new[i] if t[0] == "t"] == kept
        assert sorted(t for t in new[i] if t[0] == "n") == sorted(e[4] for e in plan if e[1] != 3)
        assert repaired(new[i], slots.get(i, {})) == text


def one_by_one(tokens, plan):
    """The edits of a plan applied to ``[value, offset, line]`` from the right,
    each moving what is behind it."""
    now, first = [list(t) for t in tokens], tokens[0][1:]
    for draw, act, pos, _, to in sorted(plan, key=lambda e: (-(e[2] - (e[1] == 1) / 2), e[0])):
        if act != 1:
            gone = now.pop(pos)
            for t in now[pos:]:
                t[1] += 1 - len(gone[0])
        if act == 3:
            continue
        if pos < len(now):
            here = [to, now[pos][1] + 1, now[pos][2]]
        elif now:
            here = [to, now[-1][1] + len(now[-1][0]) + 1, now[-1][2]]
        else:
            here = [to, *first]
        now.insert(pos, here)
        for t in now[pos + 1:]:
            t[1] += len(to) + 2
    return [tuple(t) for t in now]


def test_new_offsets_equal_edits_one_by_one(spark):
    """500 seeded plans, with neighbouring edits, deleted ends and empty results."""
    r = random.Random(31)
    rows, expected = [], {}
    for i in range(500):
        off, line, tokens = 0, 1, []
        for p in range(r.choice((1, 1, 2, 3, 5, 12))):
            off += r.randint(0, 3)
            line += r.random() < 0.3
            tokens.append((f"t{p}" + "x" * r.randint(0, 4), off, line))
            off += len(tokens[-1][0])
        plan = [(d, a, p, f, t + "y" * r.randint(0, 3) if t else t) for d, a, p, f, t in plan_of(r, len(tokens))]
        rows.append((i, [t[0] for t in tokens], [dict(zip(("draw", "act", "pos", "frm", "to"), e)) for e in plan],
                     {"off": [t[1] for t in tokens], "line": [t[2] for t in tokens]}))
        expected[i] = one_by_one(tokens, plan)
    rows += [(500, [], [], {"off": [], "line": []}), (501, None, None, None)]
    df = spark.createDataFrame(rows, f"doc long, toks array<string>, plan array<{M.EDIT_TYPE}>, "
                                     "places struct<off:array<int>,line:array<int>>").repartition(3)
    got = {x["doc"]: x["n"] for x in M.with_new_tokens(df, "toks", "plan", "places", "n").collect()}
    assert not got.pop(500) and not got.pop(501)
    assert {k: [tuple(t) for t in v] for k, v in got.items()} == expected


def test_collisions_are_drawn_again(spark):
    """Every plan holds as many draws as were drawn for it, and changes or
    deletes no token twice."""
    df = spark.createDataFrame([(i, ["a", "=", "b", "(", ")", ";"][:2 + i % 5]) for i in range(300)],
                               "doc long, toks array<string>")
    full = 0
    for x in M.with_edit_plan(df, "doc", "toks", 9).withColumn("k", M.edit_count(9, F.col("doc"))).collect():
        at = [e["pos"] for e in x["plan"] if e["act"] != 1]
        assert len(at) == len(set(at)) and len(x["plan"]) <= x["k"]
        assert [e["draw"] for e in x["plan"]] == sorted(e["draw"] for e in x["plan"])
        full += len(x["plan"]) == x["k"]
    assert full == 300


def test_missed_mutators_are_drawn_again(spark):
    """Half of the draws look for a semicolon that only one text has."""
    df = spark.createDataFrame([(i, ["x", ";"] if i % 2 else ["x", "y"]) for i in range(100)],
                               "doc long, toks array<string>")
    for x in M.with_edit_plan(df, "doc", "toks", 2, weights=(0, 0, 0, 0, 1, 0, 1)).collect():
        cut = [e for e in x["plan"] if e["act"] == 3]
        assert len(cut) == (1 if x["doc"] % 2 and cut else 0) and {e["frm"] for e in cut} <= {";"}
        assert x["doc"] % 2 or len(x["plan"]) > 0


def test_edits_carry_their_character_offset(spark):
    plan = [{"draw": d, "act": a, "pos": p, "frm": "", "to": "z"} for d, a, p in ((1, 1, 0), (2, 4, 1), (3, 1, 2))]
    df = spark.createDataFrame([(["ab", "c"], plan, [3, 9]), ([], [], [])],
                               f"toks array<string>, plan array<{M.EDIT_TYPE}>, off array<int>")
    got = df.select(M.placed(F.col("plan"), F.col("toks"), F.col("off")).alias("p")).collect()
    assert [[e["at"] for e in x["p"]] for x in got] == [[3, 9, 10], []]


def test_corrupted_texts_keep_their_reference_lines(spark):
    from repairmine.plans.corruption import corrupt_texts
    code = "#include <stdio.h>\nint main ( ) {\n  return 0 ;\n}"
    df = spark.createDataFrame([(1, code), (2, "#include <a.h>"), (3, None), (4, "")], "id long, code string")
    got = {x["id"]: x for x in corrupt_texts(df, "id", "code").collect()}
    assert set(got) == {1} and got[1]["text"].split("\n")[0] == "#include <stdio.h>" and got[1]["conflicts"] == 0
    blanked = code[code.index("\n"):]
    for e in got[1]["plan"]:
        assert blanked[e["at"]:].startswith(e["frm"])


def test_long_texts_and_long_plans_are_kept(spark):
    """No text is too long for a plan, and no plan is emptied for its length."""
    df = spark.createDataFrame([(1, ["x", "=", "1", ";"] * 2000), (2, ["return"] + ["y", "+"] * 20 + [";"])],
                               "doc long, toks array<string>")
    got = {x["doc"]: x["plan"] for x in M.with_edit_plan(df, "doc", "toks", 3, weights=(0, 0, 0, 0, 0, 1, 0)).collect()}
    assert len(got[2]) == 42 and got[1] == []
    assert len(M.with_edit_plan(df, "doc", "toks", 3).where("doc = 1").first()["plan"]) > 0


def test_plan_is_deterministic(spark):
    df = spark.createDataFrame([(1, ["int", "x", "=", "1", ";"]), (2, ["return", "y", ";"])],
                               "doc long, toks array<string>")
    a = M.with_edit_plan(df, "doc", "toks", 3).collect()
    b = M.with_edit_plan(df, "doc", "toks", 3).collect()
    assert a == b
    for r in a:
        assert 1 <= len(r["plan"]) <= 9
