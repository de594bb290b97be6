"""What five filters remove in every order they can be applied in.

Method: every document is told once which filters it fails, as a mask of five bits;
counts of masks then answer for all 120 orders, so no order reads a document again.
One filter needs the whole table: a text that a smaller id has already. Copies are
found by refining a partition of the documents: first by length in code points, then by the
hash of one block of the text after another, each larger than the one before; whoever is
alone in its class drops out at each step. The full texts of those that are
left are compared, and all but the smallest id of equal ones are marked.

For scale: the first pass leaves a narrow table (no texts), on which classes are refined
with counts that are combined before they are shuffled; a class is never gathered in
one task. For the comparison texts stay where they are read: the smallest and the
largest text of a class are aggregated, which are one exactly if all its texts are. Should hashes
have joined different texts, these classes alone are grouped by text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Scratch

#: The filters in the order of their bits, the first being bit 0.
FILTERS = "ABCDE"
#: Code points of the first block of a text; each further block ends at so many times the place.
BLOCK, GROWTH = 256, 16
#: Blocks that reach over the longest string Spark can hold.
BLOCKS = 7
#: A word is a maximal run of other characters than these.
SPACE = " \t-\r"
#: Numbers of the filter of classes that is sent to all tasks, 64 bits each, at most.
FILTER_WORDS = 1 << 20


def own_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by filter; a null text counts as empty.

    A: fewer than 200 words. B: fewer than half of the words are distinct, by case. C: more than 3 of 100
    code points are in A-Z. D: holds one of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    many, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": many < 200,
        "B": 100 * distinct < 50 * many,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def block_hashes(text: Column) -> Column:
    """The hashes of a text's blocks, each joined with those before it; the number of blocks follows the length."""
    text = F.coalesce(text, F.lit(""))
    ends = [BLOCK * GROWTH**k for k in range(BLOCKS - 1)] + [(1 << 31) - 1]
    out, before = [], F.length(text).cast("long")
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        inside = F.length(text) > begin
        before = F.when(inside, F.xxhash64(before, F.substring(text, begin + 1, min(end - begin, (1 << 31) - 1 - begin))))
        out.append(before)
    return F.array_compact(F.array(*out))


def duplicates(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text", hashes=block_hashes) -> DataFrame:
    """(id long, class long, later boolean) of every document whose text another one may have; ``later`` if a smaller id has it.

    A null text counts as empty. Rows of one id are not later than one another; a null id
    is later than none, and none is later than it. Documents that are not among
    the rows have a text of their own.
    """
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"))
    return marked(base, scratch.save(base.select("id", F.length("text").alias("size"), hashes(F.col("text")).alias("blocks"))), scratch, hashes)


def marked(texts: DataFrame, slim: DataFrame, scratch: Scratch, hashes=block_hashes) -> DataFrame:
    """As duplicates(), from (id, text) and its saved (id, size, blocks)."""
    left, step = slim.select("id", "size", "blocks", F.col("size").cast("long").alias("class")), 0
    while True:
        # who is alone in its class drops out; counts are combined before they are shuffled
        several = scratch.save(left.groupBy("class").agg(F.count("*").alias("n"), F.max(F.size("blocks")).alias("deep")).where("n > 1").select("class", "deep"))
        left = left.join(several.select("class"), "class", "left_semi")
        deep = several.agg(F.max("deep").alias("d")).first().d or 0
        if step >= deep:
            break
        # classes that have no further block stay as they are
        left = scratch.save(left.select("id", "size", "blocks", F.coalesce(F.get("blocks", F.lit(step)), F.col("class")).alias("class")))
        step += 1
    # full texts, where they are read: those whose class is surely alone are left out by bits of the classes
    known = texts.select("id", "text", F.coalesce(F.try_element_at(hashes(F.col("text")), F.lit(-1)), F.length("text").cast("long")).alias("class"))
    bits = _bits(several)
    width = F.lit(FILTER_WORDS)
    found = known.withColumn("word", F.pmod("class", width)).join(F.broadcast(bits), "word").where(F.getbit("bits", _bit(F.col("class"))) == 1)
    equal = F.min("text") == F.max("text")
    classes = scratch.save(found.groupBy("class").agg(equal.alias("equal"), F.min("id").alias("first")))
    told = left.select("id", "class").join(classes, "class")
    sure = told.where("equal").select("id", "class", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("later"))
    mixed = classes.where("not equal").select("class")
    if mixed.isEmpty():
        return sure
    # different texts of one class
    apart = scratch.save(found.join(mixed, "class", "left_semi").select("id", "class", "text"))
    firsts = scratch.save(apart.groupBy("class", "text").agg(F.min("id").alias("first")))
    apart = apart.join(firsts, ["class", "text"]).select("id", "class", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("later"))
    return sure.unionByName(apart)


def _bit(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 20), F.lit(64)).cast("int")


def _bits(classes: DataFrame) -> DataFrame:
    """(word, bits): a bit for each class, in at most FILTER_WORDS rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("class")))
    return classes.groupBy(F.pmod("class", F.lit(FILTER_WORDS)).alias("word")).agg(F.bit_or(bit).alias("bits"))


def masks(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), hashes=block_hashes) -> DataFrame:
    """(id, mask int, the columns of ``keep`` in a struct ``kept``) of every row: bit k is set if it fails filter k of FILTERS.

    Texts are read twice, for the conditions and hashes, and to compare copies.
    """
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep])
    base = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), text.alias("text"), kept.alias("kept"))
    fails = own_failures(F.col("text"))
    mask = sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in fails.items()), F.lit(0))
    slim = scratch.save(base.select("id", "kept", F.length("text").alias("size"), hashes(F.col("text")).alias("blocks"), mask.alias("mask")))
    # per id and class, as later() depends on nothing else
    twice = marked(base.select("id", "text"), slim, scratch, hashes)
    late = scratch.save(twice.where("later").select("id", "class").distinct())
    last = F.coalesce(F.try_element_at("blocks", F.lit(-1)), F.col("size").cast("long"))
    out = slim.withColumn("class", last).join(late.withColumn("late", F.lit(True)), ["id", "class"], "left")
    return out.select("id", (F.col("mask") + F.when(F.col("late"), 1 << FILTERS.index("E")).otherwise(0)).cast("int").alias("mask"), "kept")


def audit(failed: DataFrame, part: str = "part", mask: str = "mask", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """For every value of ``part``, all orders of the filters and each of their five steps: what the step does.

    ``failed`` has a row for each document: its part, its mask, and whether it is good and
    toxic. Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, zeros included; a table without rows gives none.
    """
    n = len(FILTERS)
    counts = failed.groupBy(F.col(part).alias("part"), F.col(mask).alias("mask")).agg(
        F.count("*").alias("docs"), F.sum(F.col(good).cast("long")).alias("good"), F.sum(F.col(toxic).cast("long")).alias("toxic")
    )
    # a row for each part and mask, at most 32 of each; every step reads them
    steps = [(order, k, FILTERS.index(order[k]), sum(1 << FILTERS.index(c) for c in order[:k])) for order in map("".join, permutations(FILTERS)) for k in range(n)]
    all_steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k + 1).alias("k"), F.lit(1 << f).alias("f"), F.lit(before).alias("b")) for o, k, f, before in steps])
    told = counts.withColumn("s", F.explode(all_steps))
    m = F.col("mask")
    fails, earlier = m.bitwiseAND(F.col("s.f")) != 0, m.bitwiseAND(F.col("s.b")) != 0
    share = F.floor(F.lit(_orders(n)) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")  # the orders in which one of so many filters comes first
    total = lambda c, of="docs": F.sum(F.when(c, F.col(of)).otherwise(0)).cast("long")
    return told.groupBy("part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step")).agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(m == F.col("s.f")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("docs") * share).otherwise(0)).cast("long").alias("shapley"),
    )


def _orders(n: int) -> int:
    return n * _orders(n - 1) if n else 1


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents (doc_id, text, lang) by language, with labels (doc_id, quality, toxic).

    A null language is the empty string, a null text empty. A document is good if a label row of
    its id has quality 1, toxic if one has toxic 1; ids without labels, and null ids, are
    neither. Repeated rows count each. Columns of other names are not read.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    failed = masks(docs, scratch, keep=("lang",))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = failed.join(said, "id", "left").select(F.coalesce(F.col("kept.lang").cast("string"), F.lit("")).alias("part"), "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return audit(rows)
