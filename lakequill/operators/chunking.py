"""Chunking Markdown documents (doc_id, content) and statistics of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

FENCE, HEADING = r"^\s*(```|~~~)", r"^(#{1,6})\s+(.+)$"


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, heading, heading_level, heading_path, start_line, end_line, content.

    A heading outside fences starts a section; fence lines are left out of content but counted as lines. The path
    is a stack: a heading of level n keeps the n - 1 first entries at most. Sections that are blank are numbered
    and then left out. Every fold runs over one document.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    order = Window.partitionBy("doc_id").orderBy("line")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("fence", F.col("text").rlike(FENCE)).withColumn("inside", F.sum(F.col("fence").cast("int")).over(so_far) % 2 == 1)
    lines = lines.withColumn("heads", ~F.col("fence") & ~F.col("inside") & F.col("text").rlike(HEADING)).withColumn("n", F.sum(F.col("heads").cast("int")).over(so_far))
    body = ~F.col("fence") & ~F.col("heads")
    grouped = lines.groupBy("doc_id", "n").agg(
        F.max(F.when(F.col("heads"), F.col("text"))).alias("head"), F.min("line").alias("first"), F.max("line").alias("last"), F.count_if(body).alias("body_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("line", "text")))), lambda s: s["text"]), "\n").alias("content"),
    )
    grouped = grouped.withColumn("heading_level", F.length(F.regexp_extract("head", HEADING, 1))).withColumn("heading", F.regexp_replace(F.regexp_extract("head", HEADING, 2), r"(?U)^\s+|\s+$", ""))
    numbered = with_paths(grouped)
    return numbered.where(F.col("content").rlike(r"(?U)\S")).select("doc_id", "section", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("heading_level", F.lit(0)).alias("heading_level"), "heading_path", (F.col("first") + 1).alias("start_line"), (F.col("last") + 1).alias("end_line"), "content")


def with_paths(sections: DataFrame) -> DataFrame:
    """sections (doc_id, n, heading, heading_level, body_lines, ...) with section (how many before it have body lines) and
    heading_path. A document's sections stream by in order; only the stack of open headings, six at most, is kept."""
    schema = sections.select("*", F.lit(0).cast("long").alias("section"), F.lit("").alias("heading_path")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, stack, count = object(), [], 0
        for batch in batches:
            numbers, paths = [], []
            for now, level, heading, body in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "heading_level", "heading", "body_lines")], strict=True):
                if now != doc:
                    doc, stack, count = now, [], 0
                if level:
                    stack = [*stack[: level - 1], heading]
                count += body > 0
                numbers.append(count - 1)
                paths.append(" > ".join(stack))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(paths, pa.string())], [*batch.schema.names, "section", "heading_path"])

    return sections.repartition("doc_id").sortWithinPartitions("doc_id", "n").mapInArrow(run, schema)


def packed(content: Column, size: int, overlap: int, separator: str = "\n\n") -> Column:
    """Parts of a text packed greedily up to `size` characters; each piece after the first starts with the last
    `overlap` characters of the one before. A part longer than size stays whole. One pass over a text's parts."""

    def one(text: str | None) -> list[str] | None:
        if text is None:
            return None
        out, now, length = [], [], 0
        for part in text.split(separator):
            if length and length + len(part) > size:
                out.append("".join(now))
                now = [out[-1][-overlap:]] if overlap else []
                length = len(now[0]) if now else 0
            now += [part, separator]
            length += len(part) + len(separator)
        return [*out, "".join(now)]

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        # a few texts at a time are Python strings, all else stays in Arrow's buffers
        done = [pa.array([one(x.as_py()) for x in texts[i : i + 64]], pa.list_(pa.string())) for i in range(0, len(texts), 64)]
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.string()))

    return F.filter(F.transform(pack(content), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) > 0)


def split_long(chunks: DataFrame, size: int, overlap: int, separator: str = "\n\n") -> DataFrame:
    """chunks (with content) of which those longer than `size` are split; sub_index numbers the pieces, else null."""
    long = F.length("content") > size
    pieces = F.when(long, packed(F.when(long, F.col("content")), size, overlap, separator)).otherwise(F.array("content"))
    out = chunks.withColumn("is_long", long).select("*", F.posexplode(pieces).alias("sub", "piece"))
    return out.withColumn("sub_index", F.when(F.col("is_long"), F.col("sub"))).withColumn("content", F.col("piece")).drop("is_long", "sub", "piece")


def chunk_id(doc: str = "doc_id", section: str = "section", sub: str = "sub_index") -> Column:
    return F.concat_ws("_", F.col(doc).cast("string"), F.col(section).cast("string"), F.col(sub).cast("string"))


def retrieval_text(path: str = "heading_path", content: str = "content") -> Column:
    return F.when(F.col(path) != "", F.concat(F.lit("["), F.col(path), F.lit("]\n"), F.col(content))).otherwise(F.col(content))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("content")
    return chunks.agg(F.count("*").alias("total"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias("avg_chars"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_chars"), F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_chars"))


def index_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of each document, 0 for those without any."""
    return docs.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").fillna(0, ["chunks"])


def title_prefixed(title: str, content: str, replace: bool = False) -> Column:
    """The text under `# title`; one that starts with a first-level heading keeps it, unless replaced."""
    has, head = F.col(content).startswith("# "), F.concat(F.lit("# "), F.col(title), F.lit("\n\n"))
    swapped = F.concat(F.lit("# "), F.col(title), F.regexp_replace(F.col(content), r"^[^\n]*", ""))
    return F.when(has, swapped if replace else F.col(content)).otherwise(F.concat(head, F.col(content)))


def demoted(content: Column, by: int) -> Column:
    """Headings `by` levels deeper, 6 at most."""
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    return F.array_join(F.transform(F.split(content, "\n"), lambda x: F.when(level(x) > 0, F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), level(x) + by)), F.regexp_replace(x, "^#{1,6}", ""))).otherwise(x)), "\n")


def conversion_stats(content: str) -> list[Column]:
    return [F.length(content).cast("long").alias("chars"), F.size(F.split(content, "\n")).cast("long").alias("lines"), F.floor(F.regexp_count(content, F.lit("```")) / 2).cast("long").alias("fences")]


def without_fence(content: Column) -> Column:
    """Without one fence around the whole text."""
    bare = F.regexp_replace(F.regexp_replace(content, r"^```[^\n]*\n", ""), r"\n?```$", "")
    return F.when(content.startswith("```") & content.endswith("```"), bare).otherwise(content)


def payload_cap(items: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """by, order, size and `kept`: in order, those whose size still fits beside the ones kept so far. A group's rows
    stream by in order; only the total is kept. A row without a size isn't kept."""
    rows = items.select(by, order, size).repartition(by).sortWithinPartitions(by, order, size)
    schema = rows.withColumn("kept", F.lit(True)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = object(), 0
        for batch in batches:
            kept = []
            for now, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if now != group:
                    group, used = now, 0
                fits = n is not None and used + n <= most
                used += n if fits else 0
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], [*batch.schema.names, "kept"])

    return rows.mapInArrow(run, schema)


def font_headings(spans: DataFrame) -> DataFrame:
    """spans (doc_id, page, seq, size, text) with is_heading: 1.25 times the commonest rounded size, 120 characters at most."""
    sizes = spans.groupBy("doc_id", F.round("size").alias("s")).agg(F.count("*").alias("n"))
    body = sizes.groupBy("doc_id").agg(F.max(F.struct("n", -F.col("s"))).alias("m")).select("doc_id", (-F.col("m.col2")).alias("body"))
    return spans.join(body, "doc_id").withColumn("is_heading", (F.col("size") >= 1.25 * F.col("body")) & (F.length("text") <= 120))


def span_titles(spans: DataFrame, most: int = 80) -> DataFrame:
    """doc_id, title: the first span (by page and seq) of a document's greatest size that has `most` characters at most;
    null where none has."""
    fits = F.col("size").isNotNull() & (F.length("text") <= most)
    by_size = spans.groupBy("doc_id", "size").agg(F.min(F.when(fits, F.struct("page", "seq", "text"))).alias("first"))
    return by_size.groupBy("doc_id").agg(F.max_by("first", "size").alias("first")).select("doc_id", F.col("first.text").alias("title"))


def scanned_pages(pages: DataFrame, least: int = 16, most: int = 30) -> DataFrame:
    """Pages (doc_id, page, text) with hardly any text, at most `most` of a document."""
    few = pages.where(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) < least)
    return few.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("n") <= most).drop("n")


def appended(docs: DataFrame, blocks: DataFrame, most: int | None = 20, blank: bool = False) -> DataFrame:
    """docs (doc_id, content) with up to `most` blocks (doc_id, seq, label, text; None: all) after the body; blank ones
    are skipped unless `blank`."""
    some = blocks if blank else blocks.where(F.col("text").rlike(r"(?U)\S"))
    if most is not None:
        some = some.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))).where(F.col("n") <= most)
    joined = some.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.col("text")).alias("t")))), lambda s: s["t"]), "\n\n").alias("extra"))
    return docs.join(joined, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", "content", "extra").alias("content"))


def render_tables(cells: DataFrame) -> DataFrame:
    """Markdown tables from cells (doc_id, row, col, text): padded to the widest row, blank rows dropped.

    Neighbouring cells are joined where they stand, so that each text is shuffled once and not as a row of its own; the
    rows of a document stream by in order, and one document's are held."""
    # a cleaned text has no newline, so that one can stand between cells
    clean = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    kinds = {c: cells.schema[c].dataType.simpleString() for c in ("doc_id", "row", "col")}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            last, now = batch.slice(0, batch.num_rows - 1), batch.slice(1)
            follows = pc.equal(pc.subtract(now.column("col"), last.column("col")), 1)
            for c in ("doc_id", "row"):
                follows = pc.and_(follows, pc.equal(now.column(c), last.column(c)))
            first = np.concatenate(([0], 1 + np.flatnonzero(~pc.fill_null(follows, False).to_numpy(zero_copy_only=False))))
            runs = pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows), pa.int32()), batch.column("t"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in kinds], pc.binary_join(runs, "\n")], [*kinds, "t"])

    runs = cells.select(*kinds, clean.alias("t")).mapInArrow(join, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", t string")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, row, rows, parts = object(), None, [], []
        kind = None

        def end_row() -> None:
            if len(parts) == 1:
                rows.append(parts[0][1].split("\n"))
            elif parts:
                every = [(col is not None, (col or 0) + i, t) for col, text in parts for i, t in enumerate(text.split("\n"))]
                rows.append([t for *_, t in sorted(every)])
            parts.clear()

        def table() -> str | None:
            filled = [c for c in rows if any(t.strip(" ") for t in c)]
            width = max(map(len, filled), default=0)
            lines = ["| " + " | ".join(c + [""] * (width - len(c))) + " |" for c in filled]
            return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else None

        for batch in batches:
            kind, done = batch.schema.field("doc_id").type, []
            for now, at, col, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != doc or at != row:
                    end_row()
                if now != doc:
                    done.append((doc, table()))
                    rows.clear()
                doc, row = now, at
                parts.append((col, text))
            yield out(done, kind)
        end_row()
        if kind is not None:
            yield out([(doc, table())], kind)

    def out(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        some = [x for x in done if x[1] is not None]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], kind), pa.array([x[1] for x in some], pa.string())], ["doc_id", "content"])

    return runs.repartition("doc_id").sortWithinPartitions("doc_id", "row", "col").mapInArrow(render, f"doc_id {kinds['doc_id']}, content string")


# The sentence's words below, and what goes from the front of a heading (pictures, then numbers).
def tables_to_prose(docs: DataFrame, lead: str = "{subject}的全部{heading}如下：", blank_heading: str = "内容", between: str = "，", end: str = "。") -> DataFrame:
    """docs (doc_id, content, subject, heading) with each pipe table as a sentence: a lead, then its rows with cells
    joined by spaces. A block of pipe lines whose second line is no separator stays, without leading white space; a
    table without a filled row goes. Lines of one document share a window, never the table."""
    lines = docs.select("doc_id", "subject", "heading", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    bare = F.regexp_replace("text", r"(?U)^\s+", "")
    lines = lines.withColumn("bar", bare.startswith("|")).withColumn("text", F.when(F.col("bar"), bare).otherwise(F.col("text")))
    lines = lines.withColumn("block", F.when(F.col("bar"), F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "bar").orderBy("pos"))).otherwise(-2 - F.col("pos")))
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"^\|", ""), r"\|$", "")
    separator = inner.rlike(r"^[\s:|-]*$") & inner.contains("-")
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("pos")))
    lines = lines.withColumn("table", F.max(F.col("bar") & (F.col("n") == 2) & separator).over(Window.partitionBy("doc_id", "block")))
    cells = F.filter(F.transform(F.split(inner, r"\|"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) > 0)
    rows = lines.withColumn("row", F.when(F.col("table") & (F.col("n") > 2) & (F.size(cells) > 0), F.array_join(cells, " ")))
    noun = F.regexp_replace(F.regexp_replace(F.coalesce("heading", F.lit("")), r"^[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\s]+", ""), r"^[\d一二三四五六七八九十]+[、.．:：]\s*", "")
    noun = F.coalesce(F.nullif(F.trim(noun), F.lit("")), F.lit(blank_heading))
    before, after = lead.split("{heading}")
    has = F.length(F.coalesce("subject", F.lit(""))) > 0
    bare_lead = before.replace("{subject}的", "").replace("{subject}", "")
    opening = F.concat(F.when(has, F.replace(F.lit(before), F.lit("{subject}"), F.coalesce("subject", F.lit("")))).otherwise(bare_lead), noun, F.lit(after))
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("pos", value.alias("v"))))), lambda s: s["v"])
    blocks = rows.groupBy("doc_id", "subject", "heading", "block", "table").agg(F.min("pos").alias("pos"), ordered(F.col("row")).alias("rows"), F.array_join(ordered(F.col("text")), "\n").alias("plain"))
    text = F.when(~F.col("table"), F.col("plain")).when(F.size("rows") > 0, F.concat(opening, F.array_join("rows", between), F.lit(end)))
    return blocks.withColumn("text", text).groupBy("doc_id").agg(F.array_join(ordered(F.col("text")), "\n").alias("content"))
