"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are written as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a backslash becomes `\\\\` and `<|` becomes
`<\\|` (in roles a line feed becomes backslash and line feed, too), so `<|` occurs in the template's marks alone, a written window
splits at its marks without doubt, and unescaping takes the character after each backslash as it is.

Windows: prefix sums of turn tokens cut a conversation into spans of `step` tokens, at turns; a span's last turn, if it makes
the span longer than `step`, gets a window of its own. A window holds the system turn (the first turn, if its role is system),
the latest earlier turns of at most `history` tokens together, and its own turns. Loss falls on the texts of its own assistant
turns only: repeated turns are masked out, so each assistant text is a target exactly once. A window stays within
step + history + the system turn, unless a single turn is longer than step. No turn is cut.

Tokens are counted by a rule (runs of letters, digits and single other characters, plus four for the marks): a number of the
right size for budgets that stays in the JVM. Defined cases: null text and role are empty; turns with equal numbers
follow each other by role and text; repeated rows are turns each; a null turn number comes first; conversations with a null
id form one conversation; an empty table gives no windows. A conversation is one unit: its digest covers its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")).cast("long") + 4


def windows(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", step: int = 1024, history: int = 512) -> DataFrame:
    """conv, window, n_repeated, n_tokens, formatted and loss: spans (start, length), in characters of formatted, that are targets."""
    t = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text")))
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("i", F.row_number().over(by)).withColumn("end", F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("start", F.col("end") - F.col("n"))
    # Spans by prefix sums; the last turn of a span that runs over gets its own window.
    t = t.withColumn("span", F.floor(F.col("start") / step)).withColumn("alone", (F.col("end") > (F.col("span") + 1) * step) & (F.col("start") > F.col("span") * step))
    t = t.withColumn("window", 2 * F.col("span") + F.col("alone").cast("int"))
    in_order = Window.partitionBy("conv").orderBy("i")
    first = F.coalesce(F.col("window") != F.lag("window").over(in_order), F.lit(True))
    t = t.withColumn("first", first)
    # How many turns before this one fit into the history: those that start at most `history` tokens before it.
    back = Window.partitionBy("conv").orderBy("start").rangeBetween(-history, Window.currentRow)
    t = t.withColumn("before", F.count(F.lit(1)).over(back) - 1)
    # For each turn, the windows that begin after it and reach back to it. Their first turns start at most `history` tokens after it.
    ahead = Window.partitionBy("conv").orderBy("start").rangeBetween(1, history)
    later = F.collect_list(F.when(F.col("first"), F.struct("window", "i", "before"))).over(ahead)
    t = t.withColumn("later", F.filter(later, lambda w: w["i"] - w["before"] <= F.col("i")))
    system = F.first(F.struct("role", "text", "n", "i")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("sys", F.when(system["role"] == "system", system))
    # Own turns, repeated turns, and the system turn in every window but the one whose own it is or whose history holds it.
    own = F.struct("window", F.lit(False).alias("again"), "i", "role", "text", "n")
    again = F.transform(F.filter("later", lambda w: F.col("sys").isNull() | (F.col("i") != F.col("sys.i"))), lambda w: F.struct(w["window"].alias("window"), F.lit(True).alias("again"), F.col("i").alias("i"), F.col("role").alias("role"), F.col("text").alias("text"), F.col("n").alias("n")))
    lead = F.when(F.col("first") & F.col("sys").isNotNull() & (F.col("i") != F.col("sys.i")), F.array(F.struct("window", F.lit(True).alias("again"), F.col("sys.i").alias("i"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text"), F.col("sys.n").alias("n"))))
    kind = "array<struct<window:long,again:boolean,i:int,role:string,text:string,n:long>>"
    parts = F.concat(F.array(own).cast(kind), again.cast(kind), F.coalesce(lead.cast(kind), F.array().cast(kind)))
    p = t.select("conv", F.inline(parts))
    # Place of each turn in its window.
    head, tail = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), F.lit(END + "\n")
    p = p.withColumn("body", escape(F.col("text"))).withColumn("written", F.concat(head, "body", tail)).withColumn("head", F.length(head))
    p = p.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("i", "again", "role", "written", "head", F.length("body").alias("size"), F.length("written").alias("all"), "n"))).alias("turns"))
    acc = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def add(a: Column, x: Column) -> Column:
        span = F.struct((a["at"] + x["head"]).cast("long").alias("start"), x["size"].cast("long").alias("length"))
        hit = ~x["again"] & (x["role"] == TARGET)
        return F.struct((a["at"] + x["all"]).cast("long").alias("at"), F.when(hit, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    loss = F.aggregate("turns", acc, add)["spans"]
    return p.select(
        F.col("conv").alias(conv),
        "window",
        F.size(F.filter("turns", lambda x: x["again"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"),
        F.array_join(F.transform("turns", lambda x: x["written"]), "").alias("formatted"),
        loss.alias("loss"),
    )


def read_back(written: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from windows alone."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>"), F.col("n_repeated") + 2, F.lit(1 << 30))

    def turn(seg: Column) -> Column:
        # Role up to the first line feed without a backslash before it; text up to the end mark.
        role = F.regexp_extract(seg, r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
        text = F.substring(seg, F.length(role) + 2, F.length(seg) - F.length(role) - 1 - len(END) - 1)
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    parts = written.select(
        F.col(conv).alias("conv"),
        "window",
        F.size(segments).alias("turns"),
        F.array_join(F.transform(segments, turn), "").alias("text"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))), "").alias("target"),
        F.length("formatted").alias("chars"),
    )
    all_parts = parts.groupBy("conv").agg(F.sum("turns").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "text", "target"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"))
    text, target = F.array_join(F.transform("w", lambda x: x["text"]), ""), F.array_join(F.transform("w", lambda x: x["target"]), "")
    return all_parts.select(F.col("conv").alias(conv), "n_turns", F.sha2(text, 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"), "formatted_chars")
