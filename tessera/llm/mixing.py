"""Mixing sources to target weights by pivotal dependent rounding (operator 2), in DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1 and again; they share all words by weight, none above
`CAP` times its own words, the excess reshared among the others. In closed form: with sources in the order of
cap/weight, the common rate is the greatest of (words left after capping the first k) / (weight left).

Copies: every document of a source is due target/size copies. The whole part is taken; the fractions are rounded by the
pivotal method with mass p * words: a pair of documents passes mass from one to the other, in a random direction that
keeps every expectation, until one of them is 0 or 1, and the other goes on to meet the next. A pair keeps its words
exactly. Rows that are alike throughout are one item: of m such rows floor(m * p) surely get a copy more, and one the rest.

Tree: a source's documents are dealt by a hash of the row to groups of about `GROUP`; each group is folded and leaves one
unfinished document, which goes up to the next level, until a source has one, which meets the root. About `HELD` documents
of every source are held back for the root. They all have one fraction still, so that there a document can be paired with
all the shorter ones together: it is 1 with probability p, and the others' common fraction moves so that words are kept,
in expectation not at all. The unfinished document goes first, then the held ones, longest first; what is longer than the
words or the room that the others have is put off and folded by pairs at the end. So the very last document, which alone
is rounded to its nearer side, is a short one wherever the held ones can make up for a long one.
A hot source is many groups; nothing but ids, sizes and fractions is moved. Random numbers are hashes of the rows: reruns
agree.

Defined cases: null or empty text has size 0, takes 0 words and can't carry mass; a source without words has target 0;
null is a source of its own; repeated rows are rounded each for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import reliable

WEIGHTS, CAP = (5, 2, 1), 3
GROUP, HELD = 256, 1024
WORD = r"[^\x20\x09-\x0D]+"


def row_key() -> Column:
    """A hash of what identifies a row: only rows that are alike throughout share it."""
    return F.xxhash64(*(x for name in ("doc_id", "source", "text") for x in (F.col(name).isNull(), F.col(name))))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, row_key and how many rows are alike in all of these."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    rows = docs.select("doc_id", "source", size.alias("size"), row_key().alias("row_key"))
    return rows.groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("many"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n (different rows), target: one row for each source. The windows run over these rows only."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = sources.select("*", weight.alias("weight"), (F.col("source_size") * CAP).cast("double").alias("most"))
    by_rate = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_rate.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    words_left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rated = weighed.select("*", F.greatest(words_left / weight_left, F.lit(0.0)).alias("rate"))
    common = F.max("rate").over(everything)
    return rated.select("source", "source_size", "n", F.least(common * F.col("weight"), "most").alias("target"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _whole(p: Column) -> Column:
    return (p <= 0) | (p >= 1)


def _snapped(p: Column) -> Column:
    """What rounding errors leave of 0 and 1 is 0 and 1."""
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def _chance(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of, F.lit(42)), F.lit(1 << 31)) + 0.5) / (1 << 31)


def _state(c: Column, p: Column, ended: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), p.cast("double").alias("p"), ended.alias("ended"))


def _code(place: Column, one: Column) -> Column:
    """Place and outcome of a finished document as one number."""
    return F.array((2 * place + F.when(one, 1).otherwise(0)).cast("int"))


def _pair(items: Column, s: Column, i: Column, x: Column) -> Column:
    """Passes mass between the unfinished document and that at place i, of fraction x; one of them is finished."""
    facts = F.struct(items[s["c"]]["size"].alias("c_size"), items[i]["size"].alias("x_size"), (s["p"] * items[s["c"]]["size"]).alias("c"), (x * items[i]["size"]).alias("x"), _chance(items[s["c"]]["row_key"], items[i]["row_key"]).alias("u"))

    def meet(m: Column) -> Column:
        up, down = F.least(m["c_size"] - m["c"], m["x"]), F.least(m["c"], m["x_size"] - m["x"])
        rises = m["u"] * (up + down) < down
        c_ends = F.when(rises, m["c_size"] - m["c"] <= m["x"]).otherwise(m["c"] <= m["x_size"] - m["x"])
        on_x = _snapped((m["x"] + F.when(rises, -up).otherwise(down)) / m["x_size"])
        on_c = _snapped((m["c"] + F.when(rises, up).otherwise(-down)) / m["c_size"])
        return F.when(c_ends, _state(i, on_x, F.concat(s["ended"], _code(s["c"], rises)))).otherwise(_state(s["c"], on_c, F.concat(s["ended"], _code(i, ~rises))))

    return _let(facts, meet)


def _places(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _fold(items: Column, p: Column) -> Column:
    """(items, c, p, ended): place and fraction of the unfinished document (-1: none), and the codes of the finished ones.

    Both arguments are bound once, lest every step computes them anew."""
    start = F.expr("named_struct('c', -1, 'p', 0D, 'ended', cast(array() as array<int>))")

    def step(items: Column, s: Column, i: Column, x: Column) -> Column:
        return (
            F.when(_whole(x), _state(s["c"], s["p"], F.concat(s["ended"], _code(i, x >= 1))))
            .when(s["c"] < 0, _state(i, x, s["ended"]))
            .when(_whole(s["p"]), _state(i, x, F.concat(s["ended"], _code(s["c"], s["p"] >= 1))))
            .otherwise(_pair(items, s, i, x))
        )

    def over(v: Column) -> Column:
        s = F.aggregate(_places(v["items"]), start, lambda s, i: step(v["items"], s, i, v["p"][i]))
        return _let(s, lambda s: F.struct(v["items"].alias("items"), s["c"].alias("c"), s["p"].alias("p"), s["ended"].alias("ended")))

    return _let(F.struct(items.alias("items"), p.alias("p")), over)


def _settled(items: Column) -> Column:
    """Fractions of the root's items, those not of one fraction with the others first, after pairing each with the rest.

    The state is the words and the mass of what is still to come, and the fractions of what has passed."""
    rest = F.filter(items, lambda x: x["held"])  # two sums, once for each source
    size = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x["size"])
    mass = F.aggregate(rest, F.lit(0.0), lambda s, x: s + x["size"] * x["p"])
    start = F.struct(size.alias("size"), mass.alias("mass"), F.expr("cast(array() as array<double>)").alias("p"))

    def step(s: Column, x: Column) -> Column:
        own = F.when(x["held"], F.when(s["size"] > 0, _snapped(s["mass"] / s["size"])).otherwise(0.0)).otherwise(x["p"])

        def pair(p: Column) -> Column:
            size = s["size"] - F.when(x["held"], x["size"]).otherwise(F.lit(0))
            mass = F.greatest(s["mass"] - F.when(x["held"], p * x["size"]).otherwise(0.0), F.lit(0.0))
            short = (x["size"] * (1 - p) <= mass) & (x["size"] * p <= size - mass)
            one = _chance(x["row_key"]) < p
            new_mass = F.when(one, mass - x["size"] * (1 - p)).otherwise(mass + x["size"] * p)
            put_off = _whole(p) | ~short
            return F.struct(size.alias("size"), F.when(put_off, mass).otherwise(new_mass).alias("mass"), F.concat(s["p"], F.array(F.when(put_off, p).when(one, 1.0).otherwise(0.0))).alias("p"))

        return _let(own, pair)

    return F.aggregate(items, start, step)["p"]


def rounded(docs: DataFrame) -> DataFrame:
    """item, whether one of its rows gets the copy that chance decides (one), source, source_size, target: for each
    different row of docs."""
    sizes = reliable(sized(docs))
    sources = targets(sizes)
    largest = sources.agg(F.max("n")).first()[0] or 1
    due = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(due + 1e-12)
    share = F.col("many") * F.when(due - base < 1e-9, 0.0).otherwise(due - base)
    joined = sizes.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source")))
    same = (F.col("many") == 1) & (F.col("size") > 0)  # of one fraction with the others

    def item(p: Column, held: Column) -> Column:
        return F.struct((-F.col("size")).alias("order"), "row_key", "doc_id", "size", "many", base.alias("base"), F.floor(share + 1e-9).alias("sure"), _snapped(p).alias("p"), held.alias("held"))

    held = same & (F.pmod(F.xxhash64("row_key", F.lit(0)), F.ceil(F.col("n") / float(HELD)).cast("bigint")) == 0)
    site = ["source", "source_size", "target", "n"]
    rows = joined.select(*site, item(F.greatest(share - F.floor(share + 1e-9), F.lit(0.0)), held).alias("item"))
    root, rows, finished = rows.where("item.held"), rows.where("not item.held"), []
    moved = F.expr("named_struct('order', i.order, 'row_key', i.row_key, 'doc_id', i.doc_id, 'size', i.size, 'many', i.many, 'base', i.base, 'sure', i.sure, 'p', s.p, 'held', false)")

    def folded(dealt: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
        """Items that are finished, with their outcome, and unfinished ones."""
        done = dealt.select(*site, F.explode(F.array(_fold(F.col("items"), p))).alias("s"))  # a generator: computed once
        ended = done.select(*site, F.col("s.items").alias("items"), F.explode("s.ended").alias("code"))
        ended = ended.select(*site, F.get("items", F.shiftright("code", 1)).alias("item"), (F.col("code") % 2 == 1).alias("one"))
        return ended, done.where("s.c >= 0").select(*site, "s", F.get("s.items", F.col("s.c")).alias("i")).select(*site, moved.alias("item"))

    for level in range(1, max(1, math.ceil(math.log(largest, GROUP) - 1e-9)) + 1):
        groups = F.ceil(F.col("n") / float(GROUP**level)).cast("bigint")
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("item.row_key", F.lit(level)), groups))
        dealt = dealt.groupBy(*site, "g").agg(F.sort_array(F.collect_list("item")).alias("items"))
        ended, rows = folded(dealt, F.transform("items", lambda x: x["p"]))
        finished.append(ended)
    # The unfinished one comes first, then the held ones, longest first.
    everything = root.unionByName(rows).groupBy(*site).agg(F.sort_array(F.collect_list(F.struct(F.col("item.held"), "item"))).alias("both"))
    everything = everything.withColumn("items", F.transform("both", lambda x: x["item"])).drop("both")
    ended, last = folded(everything.withColumn("settled", _settled(F.col("items"))), F.col("settled"))
    finished += [ended, last.select(*site, "item", (F.col("item.p") >= 0.5).alias("one"))]
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, row_key for every row of docs (doc_id, text, source)."""
    each = rounded(docs).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("item.many"))).alias("place"))
    more = F.when(F.col("place") <= F.col("item.sure"), 1).when((F.col("place") == F.col("item.sure") + 1) & F.col("one"), 1).otherwise(0)
    copies = F.col("item.base") + more
    return each.select("item.doc_id", "item.size", "source_size", "target", (F.col("item.size") * copies).alias("taken"), copies.alias("copies"), "source", F.col("item.row_key").alias("row_key"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs as the mix takes it: each row as often as it has copies, all columns unchanged.

    Rows that are alike throughout have copies that differ by one at most; which of them gets more makes no difference,
    so they are numbered only where there are such rows."""
    copies = F.col("item.base") * F.col("item.many") + F.col("item.sure") + F.col("one").cast("int")
    due = rounded(docs).select(F.col("item.row_key").alias("of"), F.col("item.doc_id").alias("id"), F.col("item.many").alias("rows"), copies.alias("copies")).where("copies > 0")
    due = reliable(due)
    met = docs.withColumn(KEY, row_key()).join(due, (F.col(KEY) == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    each = F.col("copies")
    if due.where("rows > 1").head(1):
        met = met.withColumn(PLACE, F.row_number().over(Window.partitionBy("of", "id").orderBy(F.lit(0))))
        each = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col(PLACE) <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    own = [F.col(f"`{name}`") for name in docs.columns]
    return met.select(*own, F.explode(F.array_repeat(F.lit(0), each.cast("int"))).alias(KEY)).select(*own)


#: Names of columns that no table has.
KEY, PLACE = "__mixing_key", "__mixing_place"
