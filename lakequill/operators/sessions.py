"""Conversations as a long table of messages (conv_id, turn, role, text), and what to keep of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakequill.functions.text import history_tokens, slug


def retain_latest(df: DataFrame, n: int, *order: Column | str, by: str | None = None, protect: Column | None = None) -> DataFrame:
    """The latest n rows (1 at least) by order, of each `by`; protected rows stay and don't count."""
    guard = F.lit(False) if protect is None else protect
    marked = df.withColumn("__guard", guard)
    latest = marked.where(~F.col("__guard"))
    if by is None:
        kept = latest.orderBy(*order).limit(max(n, 1))
    else:
        kept = latest.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= max(n, 1)).drop("__n")
    return kept.union(marked.where("__guard")).drop("__guard")


def listing(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("updated_at"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("n", rank).where(F.col("n") <= n).drop("n")


def first_messages(messages: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("n", rank).where(F.col("n") <= max(n, 0)).drop("n")


def trimmed(messages: DataFrame, rounds: int, budget: int) -> DataFrame:
    """The last 2 * rounds messages of each conversation, less the oldest ones while they exceed the budget and
    more than 2 remain; with a user's message goes the answer to it, if 3 remain at least. One fold a conversation."""
    recent = last_messages(messages, 2 * rounds).withColumn("tokens", history_tokens(F.col("text")))
    rows = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "tokens"))).alias("all"))
    total = F.aggregate("all", F.lit(0).cast("long"), lambda a, m: a + m["tokens"])
    start = F.struct(F.lit(0).alias("drop"), F.col("total").alias("left"), F.lit(False).alias("done"), F.lit(False).alias("skip"))

    def step(a: Column, i: Column) -> Column:
        at, nxt, n = F.col("all")[i], F.try_element_at("all", i + 2), F.size("all")
        go = ~a["done"] & (a["drop"] == i) & (a["left"] > budget) & (n - i > 2)
        both = go & (at["role"] == "user") & F.coalesce(nxt["role"] == "assistant", F.lit(False)) & (n - i - 1 >= 3)
        gone = F.when(both, at["tokens"] + nxt["tokens"]).when(go, at["tokens"]).otherwise(F.lit(0))
        return F.struct((a["drop"] + F.when(both, 2).when(go, 1).otherwise(0)).alias("drop"), (a["left"] - gone).alias("left"), (a["done"] | ((a["drop"] == i) & ~go)).alias("done"), F.lit(False).alias("skip"))

    dropped = F.aggregate(F.sequence(F.lit(0), F.size("all") - 1), start, step)["drop"]
    kept = rows.withColumn("total", total).withColumn("kept", F.slice("all", dropped + 1, F.size("all")))
    return kept.select("conv_id", F.explode("kept").alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


def export(messages: DataFrame) -> DataFrame:
    """conv_id, title (50 characters of the first user message) and messages as JSON."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    out = messages.groupBy("conv_id").agg(rows.alias("m"))
    title = F.substring(F.trim(F.coalesce(F.try_element_at(F.filter("m", lambda x: x["role"] == "user"), F.lit(1))["text"], F.lit(""))), 1, 50)
    return out.select("conv_id", title.alias("title"), F.size("m").alias("messages"), F.to_json("m").alias("json"))


def apply_changes(titles: DataFrame, messages: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Titles (conv_id, title) and messages after changes (conv_id, at, op, title, role, text), all of one batch.

    In the order of `at`, the last of create, rename (to the first 50 characters of the trimmed title) and delete decides
    what a conversation is: a deleted one goes with its messages, a created one is there without any but those appended
    later, and a rename of one that isn't there does nothing, as appending to one does. An append comes after
    the messages there, in the order of `at`. Other ops are an error.
    """
    known = F.col("op").isin("create", "rename", "delete", "append")
    checked = changes.withColumn("op", F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null"))))))
    last = lambda *ops: F.max(F.when(F.col("op").isin(*ops), F.col("at")))
    named = F.max_by(F.when(F.col("op").isin("create", "rename"), F.substring(F.trim("title"), 1, 50)), F.when(F.col("op").isin("create", "rename"), F.col("at")))
    latest = checked.groupBy("conv_id").agg(last("delete").alias("gone"), last("create").alias("made"), last("create", "rename").alias("named_at"), named.alias("new"))
    both = titles.withColumn("there", F.lit(True)).join(latest, "conv_id", "full_outer")
    stays = F.when(F.col("gone").isNotNull(), F.coalesce(F.col("made") > F.col("gone"), F.lit(False))).otherwise(F.col("there").isNotNull() | F.col("made").isNotNull())
    left = both.where(stays)
    since = F.greatest("gone", "made")
    now = left.select("conv_id", F.when(F.col("named_at") > F.coalesce("gone", F.lit(-1)), F.col("new")).otherwise(F.col("title")).alias("title"))
    old = messages.join(left.where("gone is null").select("conv_id"), "conv_id", "left_semi")
    added = checked.where("op = 'append'").join(left.select("conv_id", F.when(F.col("gone").isNotNull() | F.col("there").isNull(), since).alias("since")), "conv_id").where("since is null or at > since")
    turns = old.groupBy("conv_id").agg(F.max("turn").alias("most"))
    turn = F.coalesce("most", F.lit(-1)) + F.row_number().over(Window.partitionBy("conv_id").orderBy("at"))
    return now, old.unionByName(added.join(turns, "conv_id", "left").select("conv_id", turn.cast("long").alias("turn"), "role", "text"))


def syntheses(answers: DataFrame, sources: DataFrame, at: str) -> DataFrame:
    """id, file_name and content: a Markdown document of each answer, none where question or answer is blank.

    answers: id, question, answer, suffix (makes the name unique); sources: id, rank, file_name, heading, score,
    file_path, listed in order of rank. at: the time, as in 2026-01-31T12:00:00.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    # fixed values: front matter, headings and bullets that readers of these documents expect
    bullet = F.concat(F.lit("- [["), F.coalesce("file_name", F.lit("unknown")), F.lit("]]"), F.when(F.length(text("heading")) > 0, F.concat(F.lit(" ("), F.col("heading"), F.lit(")"))).otherwise(""),
                      F.lit(" · 分数 "), F.when(F.col("score").isNotNull(), F.format_string("%.3f", F.col("score").cast("double"))).otherwise(""), F.lit(" · `"), text("file_path"), F.lit("`\n"))
    listed = sources.select("id", "rank", bullet.alias("bullet")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "bullet"))).alias("b"))
    rows = answers.where((F.length(F.trim(text("question"))) > 0) & (F.length(F.trim(text("answer"))) > 0)).join(listed, "id", "left")
    n = F.when(F.col("b").isNull(), 0).otherwise(F.size("b")).cast("string")
    quoted = F.to_json(F.array("question"))
    head = F.concat(F.lit(f"---\ntype: synthesis\ndate: {at}\nquestion: "), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("\nsource_count: "), n, F.lit("\n---\n"))
    body = F.concat(head, F.lit("\n# "), F.col("question"), F.lit("\n\n"), F.regexp_replace("answer", r"(?U)^\s+|\s+$", ""), F.lit("\n\n## 来源 ("), n, F.lit(")\n\n"), F.coalesce(F.array_join(F.transform("b", lambda s: s["bullet"]), ""), F.lit("")))
    return rows.select("id", F.concat(F.lit(at[:10] + "-"), slug(F.col("question")), F.lit("-"), F.col("suffix"), F.lit(".md")).alias("file_name"), body.alias("content"))
