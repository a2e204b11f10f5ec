"""Synthetic corruption of texts.

An edit plan is drawn per text from md5 of ``(seed, doc, draw, tag)``, so it
repeats exactly for a seed, survives task retries and is checkable in
DuckDB. Planning, applying and moving offsets work on the text's own token
array inside its row (no shuffle); repair slots explode one text's elements
and use a window per text.

Edit = ``struct<draw, act, pos, frm, to>`` with the action codes of
:mod:`repairmine.operators.edits` (1 insert-before, 3 delete, 4 change).
Elements of the new text are ordered by ``o = 2 * pos`` for kept, changed
and deleted tokens and ``o = 2 * pos - 1`` for an insert before ``pos``;
several inserts at one place are ordered by draw, highest first (the last
one applied lands first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repairmine.functions.dicts import C_KEYWORDS, C_OPERATORS
from repairmine.functions.hashing import md5_int, md5_mod
from repairmine.operators.edits import CHANGE, DELETE, INSERT_BEFORE
from repairmine.operators.sample import weighted_index
from repairmine.operators.tokens import before_each, bind, identifier_set, spans, window_matches

# Draw weights of the reference job.
ACTION_WEIGHTS = (5, 1, 4)          # change, insert, delete
ACTION_CODES = (CHANGE, INSERT_BEFORE, DELETE)
CHANGE_KIND_WEIGHTS = (4, 1)        # other word, misspelling
INSERT_CLASS_WEIGHTS = (1, 3, 6)    # identifier, keyword, operator
MAX_EDITS = 9                       # edits per text: 1..9

#: Draws tried for a plan until its number of edits is reached. Of 300, fewer
#: than 8 inserts (which never collide) come once in some 10^8 texts.
TRIES = 300
#: Last draws of the stretches that a plan's fold takes one by one while the
#: plan is not full (a fold copies its state at every step).
STRETCHES = (8, 16, 32, 96, TRIES)


def keyword_pool() -> Column:
    return F.array(*[F.lit(x) for x in C_KEYWORDS])


def operator_pool() -> Column:
    return F.array(*[F.lit(x) for x in C_OPERATORS])


def draw(seed, doc: Column, d: Column, tag: str) -> Column:
    return md5_int(seed, doc, d, F.lit(tag))


def choice(weights, seed, doc: Column, d: Column, tag: str) -> Column:
    """T10 with one md5 a draw, however many weights are tried."""
    return bind(md5_mod(F.lit(sum(weights)), seed, doc, d, F.lit(tag)), lambda u: weighted_index(weights, u))


def pick(pool: Column, seed, doc: Column, d: Column, tag: str) -> Column:
    """Uniform element of a non-empty array (null for an empty one)."""
    return F.when(F.size(pool) > 0,
                  F.element_at(pool, (F.pmod(draw(seed, doc, d, tag), F.size(pool)) + 1).cast("int")))


identifier_pool = identifier_set  # K3


def misspell(name: Column, seed, doc: Column, d: Column) -> Column:
    """M4: insert one of the name's own characters, or delete one (a name of
    length 1 only gets an insert)."""
    return bind(name, lambda own: _misspelt(own, seed, doc, d))


def _misspelt(name: Column, seed, doc: Column, d: Column) -> Column:
    chars = F.array_sort(F.array_distinct(F.regexp_extract_all(name, F.lit("(?s)."), 0)))
    c = bind(chars, lambda pool: pick(pool, seed, doc, d, "mc"))
    n = F.length(name)
    big = F.lit(2147483647)
    ins = F.when(n == 1, F.lit(True)).otherwise(F.pmod(draw(seed, doc, d, "ma"), F.lit(2)) == 0)
    i_ins = F.pmod(draw(seed, doc, d, "mi"), n + 1).cast("int")
    i_del = F.pmod(draw(seed, doc, d, "md"), n).cast("int")
    inserted = bind(i_ins, lambda i: F.concat(F.substr(name, F.lit(1), i), c, F.substr(name, i + 1, big)))
    deleted = bind(i_del, lambda i: F.concat(F.substr(name, F.lit(1), i), F.substr(name, i + 2, big)))
    return F.when(ins, inserted).otherwise(deleted)


def replacement(act: Column, frm: Column, idents: Column, seed, doc: Column, d: Column) -> Column:
    """M3: value of the new token (empty for a delete)."""
    return F.when(act == DELETE, F.lit("")).otherwise(
        bind(frm, lambda old: F.coalesce(_replaced(old, idents, seed, doc, d), F.lit(""))))


def _replaced(frm: Column, idents: Column, seed, doc: Column, d: Column) -> Column:
    kind = F.when(frm == "", F.lit(0)).otherwise(choice(CHANGE_KIND_WEIGHTS, seed, doc, d, "k"))

    def of_class(cls):
        return (F.when(cls == 0, pick(idents, seed, doc, d, "w"))
                .when(cls == 1, pick(keyword_pool(), seed, doc, d, "w"))
                .otherwise(pick(operator_pool(), seed, doc, d, "w")))
    other = (F.when(F.array_contains(idents, frm), pick(idents, seed, doc, d, "w"))
             .when(frm.isin(*C_KEYWORDS), pick(keyword_pool(), seed, doc, d, "w"))
             .when(frm.isin(*C_OPERATORS), pick(operator_pool(), seed, doc, d, "w"))
             .otherwise(bind(choice(INSERT_CLASS_WEIGHTS, seed, doc, d, "c"), of_class)))
    return F.when(kind == 0, other).otherwise(misspell(frm, seed, doc, d))


def random_edit(toks: Column, idents: Column, seed, doc: Column, d: Column) -> Column:
    """M5 = M1 + M2 + M3: one random edit of a text. Action, position and old
    token are computed once each, not at every mention."""
    n = F.size(toks)

    def of(act, pos, frm):
        return F.struct(d.cast("int").alias("draw"), act.alias("act"), pos.alias("pos"), frm.alias("frm"),
                        replacement(act, frm, idents, seed, doc, d).alias("to"))

    def at(act, pos):
        return bind(F.when(act == INSERT_BEFORE, F.lit("")).otherwise(F.element_at(toks, pos + 1)),
                    lambda frm: of(act, pos, frm))

    def by(act):
        pos = F.when(act == INSERT_BEFORE, F.pmod(draw(seed, doc, d, "p"), n + 1)).otherwise(
            F.pmod(draw(seed, doc, d, "p"), n)).cast("int")
        return bind(pos, lambda p: at(act, p))
    codes = F.array(*[F.lit(c) for c in ACTION_CODES])
    return bind(F.get(codes, choice(ACTION_WEIGHTS, seed, doc, d, "a")), by)


# Mutators and their weights in the reference's table (x10);
# the reference job runs with the random mutator only.
MUTATORS = ("random", "identifier", "brace", "brace_pair", "semicolon", "return", "pointer")
ALL_MUTATOR_WEIGHTS = (644, 73, 77, 85, 70, 31, 30)
RANDOM_ONLY = (1, 0, 0, 0, 0, 0, 0)
BRACES = ("{", "}", "(", ")")
EDIT_TYPE = "struct<draw:int,act:int,pos:int,frm:string,to:string>"


def _edit(d, act, pos, frm, to) -> Column:
    return F.struct(d.cast("int").alias("draw"), F.lit(act).cast("int").alias("act"), pos.cast("int").alias("pos"),
                    frm.alias("frm"), to.alias("to"))


def _pick_pos(cands: Column, seed, doc, d, tag) -> Column:
    return bind(cands, lambda c: pick(c, seed, doc, d, tag))


def mutator_edits(kind: str, toks: Column, idents: Column, seed, doc: Column, d: Column) -> Column:
    """The edits of one mutator at a drawn matching position
    (empty when the text has no matching position)."""
    n = F.size(toks)
    idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def where(pred):
        return F.filter(idx, lambda i: (i < n) & F.coalesce(pred(F.try_element_at(toks, i + 1)), F.lit(False)))

    def tok(p):
        return F.element_at(toks, p + 1)

    def cut(p):
        return _edit(d, DELETE, p, tok(p), F.lit(""))

    def at(candidates, edits):
        empty = F.array().cast(f"array<{EDIT_TYPE}>")
        return bind(_pick_pos(candidates, seed, doc, d, "mp"), lambda p: F.when(p.isNull(), empty).otherwise(edits(p)))
    if kind == "random":
        return F.array(random_edit(toks, idents, seed, doc, d))
    if kind == "identifier":        # M10: change an identifier
        return at(where(lambda t: F.array_contains(idents, t)), lambda p: F.array(
            _edit(d, CHANGE, p, tok(p), replacement(F.lit(CHANGE), tok(p), idents, seed, doc, d))))
    if kind == "brace":             # M11: delete a brace or parenthesis
        return at(where(lambda t: t.isin(*BRACES)), lambda p: F.array(cut(p)))
    if kind == "brace_pair":        # M12: delete an adjacent ( )
        return at(window_matches(toks, [lambda t: t == "(", lambda t: t == ")"]), lambda p: F.array(cut(p), cut(p + 1)))
    if kind == "semicolon":         # M13: delete a semicolon
        return at(where(lambda t: t == ";"), lambda p: F.array(cut(p)))
    if kind == "return":            # M14: delete a whole return ... ;
        return bind(spans(toks, "return", ";"), lambda sp: at(F.transform(sp, lambda x: x["b"]), lambda p: F.transform(
            F.sequence(p, F.element_at(F.filter(sp, lambda x: x["b"] == p), 1)["e"]), cut)))
    if kind == "pointer":           # M15: drop a * or &, or put one before an identifier
        ins = F.pmod(draw(seed, doc, d, "mk"), F.lit(2)) == 1
        val = F.when(F.pmod(draw(seed, doc, d, "mv"), F.lit(2)) == 0, F.lit("*")).otherwise(F.lit("&"))
        return F.when(ins, at(where(lambda t: F.array_contains(idents, t)),
                              lambda p: F.array(_edit(d, INSERT_BEFORE, p, F.lit(""), val)))).otherwise(
            at(where(lambda t: t.isin("*", "&")), lambda p: F.array(cut(p))))
    raise ValueError(kind)


def edit_count(seed, doc: Column) -> Column:
    """k in 1..9."""
    return (F.pmod(md5_int(seed, doc, F.lit("k")), F.lit(MAX_EDITS)) + 1).cast("int")


def with_edit_plan(df: DataFrame, doc_col: str, toks_col: str, seed, out: str = "plan",
                   weights=RANDOM_ONLY) -> DataFrame:
    """M6 (+ M16): ``edit_count`` draws per text; each draw picks a mutator by
    weight (default: the random mutator only, as the reference job runs) and
    adds its edits.

    A draw whose mutator finds no position, or that would change or delete a
    token a second time, is drawn again with the next number, up to ``TRIES``
    numbers; so a plan holds its draws wherever the text allows. A plan may
    hold more actions than draws (a mutator can add several); none is cut. No
    tokens give an empty plan.
    """
    toks, doc = F.col(toks_col), F.col(doc_col)
    active = [(m, w) for m, w in zip(MUTATORS, weights) if w]

    def draw_edits(d):
        if len(active) == 1:
            return mutator_edits(active[0][0], toks, F.col("_idents"), seed, doc, d)
        def of(which):
            expr = None
            for i, (m, _) in enumerate(active):
                e = mutator_edits(m, toks, F.col("_idents"), seed, doc, d).cast(f"array<{EDIT_TYPE}>")
                expr = F.when(which == i, e) if expr is None else expr.when(which == i, e)
            return expr
        return bind(choice([w for _, w in active], seed, doc, d, "mut"), of)

    def state(n, taken, edits):
        return F.struct(n.cast("int").alias("n"), taken.cast("array<int>").alias("taken"),
                        edits.cast(f"array<{EDIT_TYPE}>").alias("edits"))

    def add(s, edits):
        own = F.transform(F.filter(edits, lambda e: e["act"] != INSERT_BEFORE), lambda e: e["pos"])
        fits = (F.size(edits) > 0) & ~F.arrays_overlap(s["taken"], own)
        return F.when(fits, state(s["n"] + 1, F.concat(s["taken"], own), F.concat(s["edits"], edits))).otherwise(s)

    full = lambda s: s["n"] >= F.col("_k")

    def step(s, d):
        return F.when(full(s), s).otherwise(bind(draw_edits(d).cast(f"array<{EDIT_TYPE}>"), lambda e: add(s, e)))

    # draws past the last one needed are not evaluated
    folded = F.aggregate(
        F.array(*[F.array(F.lit(a + 1), F.lit(b)) for a, b in zip((0, *STRETCHES), STRETCHES)]),
        state(F.lit(0), F.array(), F.array()),
        lambda s, r: F.when(full(s), s).otherwise(F.aggregate(F.sequence(F.get(r, F.lit(0)), F.get(r, F.lit(1))), s, step)),
        lambda s: s["edits"])
    return (df.withColumns({"_idents": identifier_pool(toks), "_k": edit_count(seed, doc)})
            .withColumn(out, F.when(F.size(toks) > 0, folded).otherwise(F.array().cast(f"array<{EDIT_TYPE}>")))
            .drop("_idents", "_k"))


def placed(plan: Column, toks: Column, off: Column) -> Column:
    """M2: a plan whose edits also carry ``at``, the character offset of their
    token, or of the text's end for an insert after the last one. ``off``: the
    tokens' offsets (K4)."""
    end = F.try_element_at(off, F.lit(-1)) + F.length(F.try_element_at(toks, F.lit(-1)))
    return F.transform(plan, lambda e: F.struct(
        *[e[c].alias(c) for c in ("draw", "act", "pos", "frm", "to")],
        F.when(e["pos"] < F.size(toks), F.get(off, e["pos"])).otherwise(end).alias("at")))


_ELEM_TYPE = "array<struct<o:int,sub:int,tok:string,old:string,kind:int>>"


def _elements_from(toks: Column, plan: Column, edits_at: Column) -> Column:
    base = F.transform(toks, lambda t, p: F.struct(
        (p * 2).alias("o"), F.lit(0).alias("sub"),
        F.when(F.try_element_at(edits_at, p).isNull(), t)
        .when(F.try_element_at(edits_at, p)["act"] == CHANGE, F.try_element_at(edits_at, p)["to"])
        .otherwise(F.lit(None).cast("string")).alias("tok"),
        t.alias("old"),
        F.coalesce(F.try_element_at(edits_at, p)["act"], F.lit(0)).alias("kind")))
    ins = F.transform(F.filter(plan, lambda e: e["act"] == INSERT_BEFORE), lambda e: F.struct(
        (e["pos"] * 2 - 1).alias("o"), (-e["draw"]).alias("sub"), e["to"].alias("tok"),
        F.lit("").alias("old"), F.lit(1).alias("kind")))
    return F.array_sort(F.concat(F.coalesce(base, F.array().cast(_ELEM_TYPE)), ins))


def _edits_at(plan: Column) -> Column:
    """Map position -> non-insert edit (at most one per position)."""
    return F.map_from_entries(F.transform(F.filter(plan, lambda e: e["act"] != INSERT_BEFORE),
                                          lambda e: F.struct(e["pos"], F.struct(e["act"].alias("act"),
                                                                                e["to"].alias("to")))))


def with_elements(df: DataFrame, toks_col: str, plan_col: str, out: str = "els") -> DataFrame:
    """Kept / changed / deleted tokens and inserted ones, with order keys,
    sorted: ``struct<o, sub, tok, old, kind>``; kind 0 kept, 1 inserted,
    3 deleted, 4 changed. The position -> edit map is its own projection,
    so each token does one map lookup instead of scanning the plan."""
    return (df.withColumn("_at", _edits_at(F.col(plan_col)))
            .withColumn(out, _elements_from(F.col(toks_col), F.col(plan_col), F.col("_at"))).drop("_at"))


def with_applied(df: DataFrame, toks_col: str, plan_col: str, out: str = "new_toks") -> DataFrame:
    """M7: the corrupted token array."""
    e = with_elements(df, toks_col, plan_col, "_els")
    return e.withColumn(out, F.transform(F.filter("_els", lambda x: x["kind"] != DELETE), lambda x: x["tok"])).drop(
        "_els")


def element_table(df: DataFrame, doc_col: str, toks_col: str, plan_col: str) -> DataFrame:
    """One row per element of each text: ``doc, idx, o, sub, tok, old, kind``."""
    # outer: for a plain explode Spark infers a filter on the array and pushes
    # the whole plan expression below it again
    return (with_elements(df, toks_col, plan_col, "_els").select(doc_col, F.posexplode_outer("_els").alias("idx", "e"))
            .where("e is not null").select(doc_col, "idx", "e.*"))


def repair_slots(df: DataFrame, doc_col: str, toks_col: str, plan_col: str) -> DataFrame:
    """M8: inverse repair actions per slot of the new text.

    Slot 0 is before the text, slot i the i-th token of the new text. An
    inserted token's slot gets a delete, a changed token's slot a change back
    to the old value, and a deleted token becomes an insert-after in the slot
    of the last new-text token before it (inserts at its own place do not
    count). Output ``doc, slot, actions`` with actions ``act:value`` listed
    from the right, joined by ';'.
    """
    el = element_table(df, doc_col, toks_col, plan_col)
    w = Window.partitionBy(doc_col).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    present = (F.col("kind") != DELETE).cast("int")
    el = el.withColumn("_cnt", F.sum(present).over(w))
    # slot of a deleted token: present elements with o < o_del - 1
    before = Window.partitionBy(doc_col).orderBy("o").rangeBetween(Window.unboundedPreceding, -2)
    el = el.withColumn("_cnt_before", F.coalesce(F.sum(present).over(before), F.lit(0)))
    act = (F.when(F.col("kind") == 1, F.lit(f"{DELETE}:"))
           .when(F.col("kind") == CHANGE, F.concat(F.lit(f"{CHANGE}:"), F.col("old")))
           .when(F.col("kind") == DELETE, F.concat(F.lit("2:"), F.col("old"))))
    slot = F.when(F.col("kind") == DELETE, F.col("_cnt_before")).otherwise(F.col("_cnt"))
    acts = el.where(F.col("kind") != 0).select(doc_col, slot.alias("slot"), "idx", act.alias("a"))
    return (acts.groupBy(doc_col, "slot")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("idx")).alias("k"), "a"))),
                                          lambda x: x["a"]), ";").alias("actions")))


def edits_in_order(plan: Column, toks: Column) -> Column:
    """The edits of a plan as :func:`with_elements` orders them: ``kind, tok,
    pos``; ``start``, the source token behind it; ``move``, what it adds to the
    offset of all that is behind it; ``width``, what a new token takes."""
    ins = lambda e: e["act"] == INSERT_BEFORE
    met = F.filter(plan, lambda e: ins(e) | (e["pos"] < F.size(toks)))
    ordered = F.array_sort(F.transform(met, lambda e: F.struct(
        (e["pos"] * 2 - F.when(ins(e), F.lit(1)).otherwise(F.lit(0))).alias("o"),
        F.when(ins(e), -e["draw"]).otherwise(F.lit(0)).alias("sub"),
        F.when(e["act"] != DELETE, e["to"]).alias("tok"), e["act"].alias("kind"), e["pos"].alias("pos"))))

    def measured(x):
        size = F.coalesce(F.length(x["tok"]), F.lit(0))
        old = F.when(x["kind"] == INSERT_BEFORE, F.lit(0)).otherwise(1 - F.length(F.get(toks, x["pos"])))
        return F.struct(x["kind"].alias("kind"), x["tok"].alias("tok"), x["pos"].alias("pos"),
                        (x["pos"] + F.when(x["kind"] == INSERT_BEFORE, F.lit(0)).otherwise(F.lit(1))).alias("start"),
                        (old + F.when(x["kind"] == DELETE, F.lit(0)).otherwise(size + 2)).alias("move"),
                        F.when(x["kind"] == DELETE, F.lit(0)).otherwise(size + 1).alias("width"))
    return F.transform(ordered, measured)


def new_tokens(toks: Column, plan: Column, places: Column) -> Column:
    """M7 + M9: the new text's tokens, an array of ``tok, off, line``, as
    applying the edits one by one from the right gives them.

    An edit moves all that is behind it: a delete by ``1 - len(old)``, an
    insert by ``len(new) + 2``, a change by both. A new token stands on the
    line of the token that then follows it and one place behind that token's
    start, which moves on; with none behind, one place after the end of the
    source token before it; with none before either, where the text's first
    token stood. So a token that stays ends at its old offset plus all moves
    before it, and a row of new tokens is laid out leftwards from the next
    one that stays. ``places``: K4 of the source text. Running sums run over
    the edits; the tokens between two edits move by one number. In the row and
    in Spark expressions, so no row waits for a Python worker.
    """
    add = lambda a, b: a + b
    parts = ("tok", "off", "line")

    def arrays(tok, off, line):
        return F.struct(*[x.alias(c) for x, c in zip((tok, off, line), parts)])

    def by_edits(src, edits):
        def told(moved, laid):  # the edits with their sums and the token of the next edit
            return F.transform(edits, lambda x, i: F.struct(
                *[x[c].alias(c) for c in ("kind", "tok", "pos", "start", "width")],
                F.coalesce(F.get(edits, i + 1)["pos"], F.size(src["tok"])).alias("end"),
                F.get(moved, i).alias("moved"), (F.get(moved, i) + x["move"]).alias("shift"),
                F.get(laid, i).alias("laid")))
        sums = F.struct(*[before_each(F.transform(edits, lambda x: x[c]), add, F.lit(0)).alias(c)
                          for c in ("move", "width")])
        return bind(sums, lambda s: bind(told(s["move"], s["width"]), lambda e: laid_out(src, e)))

    def kept(src, start, end, shift):
        tok, off, line = (F.slice(src[c], start + 1, F.greatest(end - start, F.lit(0))) for c in parts)
        return arrays(tok, F.transform(off, lambda x: x + shift), line)

    def after_last(src, z):  # where the last new token begins to be laid out
        prev = F.greatest(z["pos"] - 1, F.lit(0))
        end = F.when(z["pos"] > 0, F.length(F.get(src["tok"], prev)) + 1).otherwise(F.lit(0))
        return F.struct((F.get(src["off"], prev) + end + z["moved"] - z["laid"]).alias("off"),
                        F.get(src["line"], prev).alias("line"))

    def laid_out(src, e):
        # what new tokens are laid out from: the next token that stays, or what is after the last
        stays = F.transform(e, lambda x: F.when(x["end"] > x["start"], F.struct(
            (F.get(src["off"], x["start"]) + x["shift"] - x["laid"] - x["width"]).alias("off"),
            F.get(src["line"], x["start"]).alias("line"))))
        tail = bind(F.try_element_at(F.filter(e, lambda x: x["kind"] != DELETE), F.lit(-1)), lambda z: after_last(src, z))

        def laid_from(at):
            later = F.reverse(before_each(F.reverse(at), lambda a, b: F.coalesce(b, a),
                                          F.lit(None).cast("struct<off:int,line:int>")))
            return F.zip_with(at, later, lambda own, next_: F.coalesce(own, next_))

        def piece(x, a):
            new = [F.when(x["kind"] != DELETE, F.array(y)).otherwise(F.array().cast(f"array<{kind}>"))
                   for y, kind in ((x["tok"], "string"), (a["off"] + x["laid"], "int"), (a["line"], "int"))]
            return bind(kept(src, x["start"], x["end"], x["shift"]),
                        lambda k: arrays(*[F.concat(y, k[c]) for y, c in zip(new, parts)]))

        def pieces(found, last):
            return F.zip_with(e, found, lambda x, a: bind(F.coalesce(a, last), lambda b: piece(x, b)))

        def joined(x):
            return F.arrays_zip(*[F.flatten(F.transform(x, lambda y: y[c])).alias(c) for c in parts])
        first = kept(src, F.lit(0), F.coalesce(F.get(e, F.lit(0))["pos"], F.size(src["tok"])), F.lit(0))
        return bind(F.concat(F.array(first), bind(tail, lambda last: pieces(bind(stays, laid_from), last))), joined)

    src = F.struct(F.coalesce(toks, F.array().cast("array<string>")).alias("tok"), places["off"].alias("off"),
                   places["line"].alias("line"))
    return bind(src, lambda s: bind(edits_in_order(plan, s["tok"]), lambda e: by_edits(s, e)))


def with_new_tokens(df: DataFrame, toks_col: str, plan_col: str, places_col: str, out: str = "new_tokens") -> DataFrame:
    """M7 + M9 in the row: :func:`new_tokens`."""
    return df.withColumn(out, new_tokens(F.col(toks_col), F.col(plan_col), F.col(places_col)))
