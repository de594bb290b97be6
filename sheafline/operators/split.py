"""Split plans carried out: documents of parts become chunks, stage by stage.

A piece is a run of a document's parts, known by the number of its first one, until a
separator cuts inside its text. So stages that only regroup parts never build
a text: part rows get another first part, sizes are sums, and only what is left at the end, or
what a separator has to search, is put together. Groups are worked on in blocks of
parts (see groups), so one document may hold any share of all parts as long as
no piece of it that becomes a text outgrows a row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.embedders import dense
from ..plans.config import IndexConfig
from ..plans.split_plan import Stage, parse
from .chunking import contextual_prefix, pack_words, windows
from .groups import with_running, with_totals
from .saved import saved

#: Marks a cut in a line until its piece's text is put together; a noncharacter that texts should not hold.
_CUT = "\ufdd0\ufdd1"
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: The share of a piece's similarities at or below which consecutive parts have drifted apart.
DRIFT_SHARE = 0.35


def number_parts(parts: DataFrame, prefix: str = "") -> DataFrame:
    """``parts`` (doc_id, part_idx, text, labels) with idx, from 0 in each document, line, size and start (0).

    A null text is empty; parts of one part_idx are in the order of their texts; a label named by
    ``prefix`` stands before each line.
    """
    text = F.coalesce("text", F.lit(""))
    line = F.concat(F.coalesce(F.col(prefix).cast("string"), F.lit("")), F.lit(": "), text) if prefix else text
    rows = parts.withColumn("text", text).withColumn("line", line)
    rows = with_running(rows, ["doc_id"], ["part_idx", "line"], "sum", F.lit(1), "idx")
    return rows.withColumn("idx", (F.col("idx") - 1).cast("long")).withColumn("size", F.length("line")).withColumn("start", F.lit(0).cast("long"))


def _sized(rows: DataFrame, join: str) -> DataFrame:
    """Adds the characters and the number of parts of every row's piece."""
    rows = with_totals(rows, ["doc_id", "start"], "idx", {"_sum": ("sum", F.col("size")), "_parts": ("count", F.lit(1))})
    return rows.withColumn("_chars", F.col("_sum") + (F.col("_parts") - 1) * len(join)).drop("_sum")


def _meets(stage: Stage) -> Column:
    """Whether a part has the stage's labels, all or any of them; a missing label is none."""
    holds = [F.coalesce(F.col(a.label).cast("string") == a.value, F.lit(False)) for a in stage.atoms if a.kind == "label"]
    out = F.lit(stage.join == "and")
    for h in holds:
        out = out & h if stage.join == "and" else out | h
    return out if holds else F.lit(False)


def dense_parts(rows: DataFrame, embedder: str = "ascii-hash") -> DataFrame:
    """(doc_id, idx, vec): the hash embedding of every part that has one, as an array."""
    return dense(rows.select(F.struct("doc_id", "idx").alias("id"), "text"), embedder).select("id.*", "vec")


def _drift(rows: DataFrame, stage: Stage, budget: int, embed) -> DataFrame:
    """A new start for the parts of pieces of three parts or more; rows need _parts. Similarities are compared to twelve places."""
    vec = embed(rows.select("doc_id", "idx", "text"))
    last = vec.select("doc_id", (F.col("idx") + 1).alias("idx"), F.col("vec").alias("_last"))
    # parts without a vector are like nothing
    rows = rows.join(vec, ["doc_id", "idx"], "left").join(last, ["doc_id", "idx"], "left")
    sim = F.when(F.col("idx") > F.col("start"), F.coalesce(vectors.dot(F.col("_last"), F.col("vec")), F.lit(0.0)))
    rows = saved(rows.withColumn("_sim", sim).drop("vec", "_last"), "drift")
    edges = rows.groupBy("doc_id", "start").agg(F.percentile("_sim", DRIFT_SHARE).alias("_edge"))
    rows = rows.join(edges, ["doc_id", "start"])
    marked = F.lit(False)
    seen = F.trim(F.regexp_replace("text", r"\s+", " "))
    for a in stage.atoms:
        if a.kind == "separator":
            marked = marked | F.contains(seen, F.lit(" ".join(a.value.split())))
    cut = (F.col("idx") == F.col("start")) | F.coalesce(F.col("_sim") <= F.col("_edge") + 1e-12, F.lit(False)) | marked
    rows = saved(with_running(saved(rows, "drift"), ["doc_id"], ["idx"], "max", F.when(cut, F.col("idx")), "_segment"), "drift")
    # what lies between two such cuts is cut by size, one part after another; a third of all parts are cuts already
    runs = rows.groupBy("doc_id", "_segment").agg(F.array_sort(F.collect_list(F.struct("idx", F.length("text").alias("n")))).alias("p"))
    firsts = F.expr(f"""aggregate(slice(p, 2, size(p)), named_struct('size', p[0].n, 'o', array(p[0].idx)), (a, x) ->
      if(a.size + x.n > {2 * budget}, named_struct('size', x.n, 'o', concat(a.o, array(x.idx))), named_struct('size', a.size + x.n, 'o', a.o)), a -> a.o)""")
    found = runs.select("doc_id", F.explode(firsts).alias("idx")).withColumn("_opens", F.lit(True))
    rows = saved(rows.join(found, ["doc_id", "idx"], "left"), "drift")
    rows = with_running(rows, ["doc_id"], ["idx"], "max", F.when(F.col("_opens"), F.col("idx")), "_new")
    return rows.withColumn("start", F.when(F.col("_parts") > 2, F.col("_new")).otherwise(F.col("start"))).drop("_sim", "_edge", "_segment", "_opens", "_new")


def _literals(stage: Stage) -> str:
    """A pattern of what the stage's literals cut: the longest at a place, or none if not all can begin at one."""
    longest = sorted((a.value for a in stage.atoms if a.kind == "separator"), key=len, reverse=True)
    if stage.join == "and":
        longest = longest[:1] if all(longest[0].startswith(x) for x in longest) else []
    return "|".join(r"\Q" + x + r"\E" for x in longest)


def _cut_lines(rows: DataFrame, stage: Stage) -> Column:
    """Lines with the cuts of literals and labels marked in them; a cut never reaches across parts."""
    pattern, chosen = _literals(stage), _meets(stage)
    cut = F.regexp_replace("line", pattern, _CUT) if pattern else F.col("line")
    if stage.join == "and":
        return F.when(chosen, cut).otherwise(F.col("line"))
    return F.when(chosen & (F.col("idx") > F.col("start")), F.concat(F.lit(_CUT), cut)).otherwise(cut)


def _rendered(rows: DataFrame, join: str, line: Column | None = None) -> DataFrame:
    """(doc_id, start, end, text): the pieces' lines in order."""
    whole = rows.groupBy("doc_id", "start").agg(F.max("idx").alias("end"), F.array_sort(F.collect_list(F.struct("idx", (line if line is not None else F.col("line")).alias("line")))).alias("p"))
    return whole.select("doc_id", "start", "end", F.array_join(F.transform("p", lambda x: x["line"]), join).alias("text"))


def _separated(texts: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, start, path, text) cut at a pattern; what is empty without its outer white space goes."""
    cut = F.split("text", pattern, -1) if pattern else F.array("text")
    pieces = F.filter(F.transform(cut, lambda x: F.regexp_replace(x, _STRIP, "")), lambda x: x != "")
    return texts.select("doc_id", "start", "path", F.posexplode(pieces).alias("_at", "text")).select("doc_id", "start", F.concat("path", F.array("_at")).alias("path"), "text")


def _divided(pieces: DataFrame, budget: int, overlap: int) -> DataFrame:
    """Pieces (doc_id, start, end, path, text) beyond the budget, at words; rows are independent."""
    names = ["doc_id", "start", "end"]

    def run(batches):
        for batch in batches:
            at, paths, texts = [], [], []
            for i, (path, text) in enumerate(zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                cut = windows(text, budget, overlap) if overlap else pack_words(text, budget)
                at += [i] * len(cut)
                paths += [[*path, k] for k in range(len(cut))]
                texts += cut
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in names], pa.array(paths, pa.list_(pa.int32())), pa.array(texts, pa.string())], [*names, "path", "text"])

    schema = f"doc_id {dict(pieces.dtypes)['doc_id']}, start long, end long, path array<int>, text string"
    return pieces.select(*names, "path", "text").mapInArrow(run, schema)


def carry_out(parts: DataFrame, plan: str, budget: int = 500, overlap: int = 0, join: str = "\n", prefix: str = "", embed=dense_parts) -> tuple[DataFrame, DataFrame]:
    """The chunks of documents of parts, and the parts that are left whole with the first part of their piece.

    parts: doc_id, part_idx, text and the labels that the plan or ``prefix`` names. A stage with
    ``over-budget`` leaves pieces of up to ``budget`` characters alone. What is longer at the end is
    divided at words, with ``overlap`` characters repeated. A piece that a separator has cut has no
    parts any more, and stages that need parts leave it alone.

    Chunks: doc_id, chunk_no long from 0, chunk_id ``<doc_id>:c<chunk_no>``, part_start, part_end
    (long, -1 where the parts are not known), text.
    """
    stages = parse(plan)
    rows = saved(number_parts(parts, prefix), "parts")
    texts: DataFrame | None = None  # doc_id, start, path, text
    first = stages[0].atoms[0].kind
    if first == "part":
        rows = rows.withColumn("start", F.col("idx"))
    for stage in stages[1:]:
        kinds = {a.kind for a in stage.atoms}
        rows = saved(_sized(rows, join), "parts")
        touched = F.col("_chars") > budget if stage.over_budget else F.lit(True)
        if "separator" in kinds and "drift" not in kinds:
            pattern = _literals(stage)
            chosen = rows.where(touched)
            if "label" in kinds:
                fresh = _separated(_rendered(chosen, join, _cut_lines(chosen, stage)).withColumn("path", F.array().cast("array<int>")), _CUT)
            else:
                fresh = _separated(_rendered(chosen, join).withColumn("path", F.array().cast("array<int>")), pattern)
            if texts is not None:
                long = F.length("text") > budget if stage.over_budget else F.lit(True)
                fresh = fresh.unionByName(texts.where(~long)).unionByName(_separated(texts.where(long), pattern))
            texts = saved(fresh, "pieces")
            rows = rows.where(~touched)
        elif "drift" in kinds:
            left = rows.where(~touched)
            rows = _drift(rows.where(touched), stage, budget, embed).unionByName(left)
        elif kinds == {"part"}:
            rows = rows.withColumn("start", F.when(touched, F.col("idx")).otherwise(F.col("start")))
        elif kinds == {"label"}:
            rows = with_running(rows, ["doc_id"], ["idx"], "max", F.when(_meets(stage), F.col("idx")), "_opening")
            rows = rows.withColumn("start", F.when(touched, F.greatest("start", F.coalesce("_opening", F.lit(0)))).otherwise(F.col("start"))).drop("_opening")
        elif kinds != {"document"}:
            raise ValueError(f"a stage cannot mix {', '.join(sorted(kinds))}")
        rows = saved(rows.drop("_chars", "_parts"), "parts")
    whole = saved(_rendered(rows, join).withColumn("path", F.array().cast("array<int>")), "pieces")
    # a division of one part still spans that part; one of several does not say which
    known = F.when(F.col("start") == F.col("end"), F.col("start")).otherwise(-1)
    short = whole.where(F.length("text") <= budget).select("doc_id", "start", "path", "text", F.col("start").alias("part_start"), F.col("end").alias("part_end"))
    long = _divided(whole.where(F.length("text") > budget), budget, overlap).select("doc_id", "start", "path", "text", known.alias("part_start"), known.alias("part_end"))
    out = short.unionByName(long)
    if texts is not None:
        lost = F.lit(-1).cast("long")
        spans = texts.where(F.length("text") <= budget).unionByName(
            _divided(texts.where(F.length("text") > budget).withColumn("end", lost), budget, overlap).select("doc_id", "start", "path", "text")
        )
        out = out.unionByName(spans.select("doc_id", "start", "path", "text", lost.alias("part_start"), lost.alias("part_end")))
    return _numbered(saved(out, "pieces")), rows


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with their numbers in the order of first parts and places within their pieces."""
    place = F.row_number().over(W.partitionBy("doc_id", "start").orderBy("path"))
    many = chunks.groupBy("doc_id", "start").agg(F.count("*").alias("_many"))
    many = with_running(many, ["doc_id"], ["start"], "sum", F.col("_many"), "_upto")
    told = chunks.withColumn("_place", place).alias("a").join(many.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.start = b.start"))
    number = F.col("b._upto") - F.col("b._many") + F.col("a._place") - 1
    told = told.select("a.doc_id", number.cast("long").alias("chunk_no"), "a.part_start", "a.part_end", "a.text")
    return told.withColumn("chunk_id", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":c"), F.col("chunk_no").cast("string")))


def index_chunks(parts: DataFrame, documents: DataFrame, config: IndexConfig, document_labels: list[str] = [], part_labels: list[str] = []) -> DataFrame:  # noqa: B006
    """The chunks of an index: those of carry_out(), with prefixes and labels.

    documents: doc_id and document labels, one row each. The prefix of a contextual index names the
    document labels that are present, in the order given; it is a column and stands before the text. Document labels come with
    every chunk; part labels (columns of ``parts``) as the distinct values of the chunk's parts
    in their order, null where the chunk's parts are not known.
    """
    problems = config.problems()
    if problems:
        raise ValueError("; ".join(problems))
    chunks, rows = carry_out(
        parts, config.split_plan, config.chunk_chars, config.overlap, config.part_join, config.part_prefix, lambda p: dense_parts(p, config.embedder)
    )
    labelled = documents.select("doc_id", *document_labels)
    prefix = contextual_prefix([(c, F.col(c)) for c in document_labels]) if config.contextual else F.lit("")
    out = chunks.join(labelled, "doc_id", "left").withColumn("prefix", prefix)
    if part_labels:
        own = F.array_sort(F.collect_list(F.struct("idx", *[F.col(c).cast("string").alias(c) for c in part_labels])))
        flow = rows.groupBy("doc_id", F.col("start").alias("part_start")).agg(own.alias("p"))
        flow = flow.select("doc_id", "part_start", *[F.array_compact(F.array_distinct(F.col(f"p.`{c}`"))).alias(c) for c in part_labels])
        out = out.join(flow, ["doc_id", "part_start"], "left")
    return out.select("doc_id", "chunk_no", "chunk_id", "part_start", "part_end", "prefix", *document_labels, *part_labels, F.concat("prefix", "text").alias("text"))
