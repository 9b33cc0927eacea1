"""Words to lines to pages, repeated lines, running balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions.text import SIGNED_FLOW, let, squeeze


def lines_of(words: DataFrame, key: str = "document_id", height: float = 6.0) -> DataFrame:
    """Lines from word boxes: words of a page whose y rounds to the same band, from left to right."""
    band = F.bround(F.col("y_min") / height).cast("int")
    by = words.groupBy(key, "page", band.alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("x_min", "seq", "text"))).alias("w"), F.min("x_min").alias("x0"), F.min("y_min").alias("y0"), F.max("x_max").alias("x1"), F.max("y_max").alias("y1")
    )
    text = squeeze(F.array_join(F.transform("w", lambda w: w["text"]), " "))
    return by.select(key, "page", "band", text.alias("text"), F.col("x0").alias("x_min"), F.col("y0").alias("y_min"), F.col("x1").alias("x_max"), F.col("y1").alias("y_max")).where("text <> ''")


def runs(items: Column, *key: str) -> Column:
    """Neighbours that are equal in some fields, as arrays. Fields are compared one by one: no struct is made for a key."""

    def cut(own: Column) -> Column:
        def starts(x: Column, i: Column) -> Column:
            new = i == 0
            for c in key:
                new = new | ~x[c].eqNullSafe(F.get(own, i - 1)[c])
            return F.when(new, i)

        first = F.filter(F.transform(own, starts), lambda i: i.isNotNull())
        return let(first, lambda at: F.transform(at, lambda a, k: F.slice(own, a + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - a)))

    return let(items, cut)


def joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def lines_within(boxes: Column, height: float = 6.0) -> Column:
    """lines_of for the word boxes (page, seq, text, x_min, y_min, x_max, y_max) of one document as an array, within its
    row: words are neither exploded nor shuffled."""
    banded = F.transform(boxes, lambda b: F.struct(b["page"].alias("page"), F.bround(b["y_min"] / height).cast("int").alias("band"), *(b[c].alias(c) for c in ("x_min", "seq", "text", "y_min", "x_max", "y_max"))))
    edge = lambda ws, f, c: f(F.transform(ws, lambda w: w[c])).alias(c)
    line = lambda ws: F.struct(ws[0]["page"].alias("page"), ws[0]["band"].alias("band"), squeeze(joined(ws)).alias("text"), edge(ws, F.array_min, "x_min"), edge(ws, F.array_min, "y_min"), edge(ws, F.array_max, "x_max"), edge(ws, F.array_max, "y_max"))
    return F.filter(F.transform(runs(F.sort_array(banded), "page", "band"), line), lambda x: x["text"] != "")


def page_text_within(boxes: Column, page_count: Column, height: float = 18.0, x: str = "x", y: str = "y", numbered: bool = True) -> Column:
    """page_text for the word boxes (page, seq, text, x, y, and line_num, block_num, par_num if numbered) of one document as
    an array, within its row. Lines by height are named once each, not for every word."""

    def banded(b: Column) -> Column:
        number = F.nullif(b["line_num"].cast("string"), F.lit("")) if numbered else F.lit(None).cast("string")
        band = F.bround(b[y] / height)
        return F.struct(b["page"].alias("page"), number_label(number, b).alias("label") if numbered else number.alias("label"), (F.when(number.isNull(), band) if numbered else band).alias("band"), b[x].alias("x"), b["seq"].alias("seq"), b["text"].alias("text"), b[y].alias("y"))

    def number_label(number: Column, b: Column) -> Column:
        return F.when(number.isNotNull(), F.concat_ws("/", b["block_num"].cast("string"), b["par_num"].cast("string"), number))

    least = lambda ws, c: F.array_min(F.transform(ws, lambda w: w[c])).alias(c)
    name = lambda w: F.coalesce(w["label"], F.concat(F.lit("y"), w["band"].cast("string")))
    line = lambda ws: F.struct(ws[0]["page"].alias("page"), least(ws, "y"), least(ws, "x"), name(ws[0]).alias("line"), F.trim(joined(ws)).alias("text"))
    lines = F.filter(F.transform(runs(F.sort_array(F.transform(boxes, banded)), "page", "label", "band"), line), lambda s: s["text"] != "")
    page = lambda ls: F.struct(ls[0]["page"].alias("page"), F.array_join(F.transform(ls, lambda x: x["text"]), "\n").alias("text"))
    every = F.transform(runs(F.sort_array(lines), "page"), page)
    filled = let(every, lambda ps: F.transform(F.sequence(F.lit(1), page_count), lambda n: F.coalesce(F.get(F.filter(ps, lambda p: p["page"] == n), F.lit(0))["text"], F.lit(""))))
    return F.when(page_count > 0, F.array_join(filled, "\n\f\n"))


def page_text(words: DataFrame, pages: DataFrame, key: str = "document_id", height: float = 18.0) -> DataFrame:
    """A document's text: lines by the recogniser's line number, else by height; blank pages keep their place.

    pages gives page_count of each key.
    """
    own = F.coalesce(F.nullif(F.col("line_num").cast("string"), F.lit("")), F.lit(""))
    line = F.when(own != "", F.concat_ws("/", F.col("block_num").cast("string"), F.col("par_num").cast("string"), own)).otherwise(F.concat(F.lit("y"), F.bround(F.col("y") / height).cast("string")))
    lines = words.groupBy(key, "page", line.alias("line")).agg(F.min("y").alias("y"), F.min("x").alias("x"), F.array_sort(F.collect_list(F.struct("x", "seq", "text"))).alias("w"))
    lines = lines.select(key, "page", "y", "x", "line", F.trim(F.array_join(F.transform("w", lambda w: w["text"]), " ")).alias("text")).where("text <> ''")
    by_page = lines.groupBy(key, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    all_pages = pages.where("page_count > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    filled = all_pages.join(by_page, [key, "page"], "left").select(key, "page", F.coalesce("text", F.lit("")).alias("text"))
    return filled.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n\f\n").alias("text"))


def repeated_lines(text: Column, least: int = 6) -> Column:
    """(line_count, duplicate_line_ratio) of a text: its normalised lines of at least so many characters, and the share of
    them that occur more than once. Equal lines stand together once sorted, so rows are neither exploded nor shuffled."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s&&[^\n]]+", " "))
    lines = F.array_sort(F.filter(F.split(flat, " ?\n ?"), lambda s: F.char_length(s) >= least))

    def counted(own: Column) -> Column:
        twin = lambda s, i: F.coalesce(s == F.get(own, i - 1), F.lit(False)) | F.coalesce(s == F.get(own, i + 1), F.lit(False))
        again = F.size(F.array_remove(F.transform(own, twin), False))
        return F.struct(F.size(own).cast("bigint").alias("line_count"), F.bround(F.try_divide(again, F.size(own)), 4).alias("duplicate_line_ratio"))

    return F.transform(F.array(lines), counted)[0]


def word_counts(text: Column) -> Column:
    """(words, distinct_words) between spaces and line breaks; distinct ones in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \n]+"), "")
    return F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words")))[0]


def balance_breaks(rows: DataFrame, key: str, order: list[str], tolerance: float = 0.05) -> DataFrame:
    """Rows and breaks of each running balance: the last balance and the flow must give this balance; null flows are skipped."""
    before = F.lag("balance").over(Window.partitionBy(key).orderBy(*order))
    broken = F.col("flow").isNotNull() & (F.abs(before + F.col("flow") - F.col("balance")) > tolerance)
    marked = rows.select(key, broken.alias("broken"))
    return marked.groupBy(key).agg(F.count("*").alias("balance_rows"), F.count_if("broken").alias("balance_breaks"))


def balance_rows(lines: DataFrame, key: str = "document_id", order: str = "band") -> DataFrame:
    """(flow, balance) of the lines that name a balance; signs inside dates are no flow."""
    n = r"([+-]?[0-9][0-9,]*(?:\.[0-9]{1,2})?)"
    plain = lambda p: F.replace(F.regexp_extract("text", p, 1), F.lit(","), F.lit("")).try_cast("double")
    return lines.select(key, F.col(order).alias("position"), plain(SIGNED_FLOW).alias("flow"), plain(rf"(?i)(?:Balance|余额)\s*[:：]?\s*{n}").alias("balance")).where("balance is not null")


def marker_flags(words: DataFrame, tokens: tuple[str, ...], key: str = "document_id") -> DataFrame:
    """Documents in whose words, put together in order, one of the tokens occurs."""
    from docassay.functions.text import tokens_in

    blob = words.groupBy(key).agg(joined(F.array_sort(F.collect_list(F.struct("seq", "text")))).alias("blob"))
    hit = blob.select(key, F.array_sort(F.array_distinct(tokens_in("blob", tokens))).alias("hits"))
    return hit.select(key, (F.size("hits") > 0).cast("int").alias("marker_flag"), F.array_join("hits", ";").alias("marker_tokens"))


def markers_within(boxes: Column, tokens: tuple[str, ...]) -> Column:
    """(marker_flag, marker_tokens) of marker_flags for the words (seq, text) of one document as an array, within its row."""
    from docassay.functions.text import tokens_in

    blob = joined(F.sort_array(F.transform(boxes, lambda b: F.struct(b["seq"].alias("seq"), b["text"].alias("text")))))
    hits = let(F.lower(blob), lambda low: F.array_sort(F.array_distinct(tokens_in(low, tokens))))
    return let(hits, lambda h: F.struct((F.size(h) > 0).cast("int").alias("marker_flag"), F.array_join(h, ";").alias("marker_tokens")))


def documents_of_pages(pages: DataFrame, key: str, metrics: list[str], score: str, page: str = "page") -> DataFrame:
    """Pages to documents: maxima of metrics, the rest of the page of highest score (the first of equals), page count."""
    rest = [c for c in pages.columns if c not in (key, *metrics)]
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(page)).alias("p"), F.struct(*rest).alias("row")))["row"]
    by = pages.groupBy(key).agg(F.count("*").alias("page_count"), *(F.max(m).alias(m) for m in metrics), best.alias("row"))
    return by.select(key, "page_count", *metrics, *(F.col("row")[c].alias(f"best_{c}") for c in rest))
