"""Fields and line items from recognized document text.

Everything is array expressions over the lines of one page; nothing is truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.lists import extract_all, matches_any, non_empty, squeeze, strip
from ...functions.sequence import first_rows
from ...functions.staging import staged

# --- Fixed values: patterns of the packet families ----------------------------------------
MONEY = r"(?iU)(?:[$€£]|RM|MYR)?\s*(\d{1,3}(?:[,\s]\d{3})*\.\d{2}|\d+\.\d{2})"
CLAIM_DATES = (
    (r"(?i)TRANSACTION\s*DATE[:\s]*([0-3]?\d[/\-][01]?\d[/\-]\d{2,4}|\d{4}-\d{2}-\d{2})", 50, True), (r"(?i)PURCHASE\s*DATE[:\s]*([0-3]?\d[/\-][01]?\d[/\-]\d{2,4}|\d{4}-\d{2}-\d{2})", 40, True),
    (r"(?i)DATE[:\s]*([0-3]?\d[/\-][01]?\d[/\-]\d{2,4}|\d{4}-\d{2}-\d{2})", 10, True), (r"\b(20\d{2}-\d{2}-\d{2})\b", 5, True),
    (r"\b([0-3]?\d-[01]?\d-20\d{2})\b", 5, True), (r"\b([01]?\d/[0-3]?\d/20\d{2})\b", 4, False),
)
SETTLEMENT_DATES = (
    (r"(?i)ISSUE\s*DATE[:\s]*([0-3]?\d[/\-][01]?\d[/\-]\d{2,4}|\d{4}-\d{2}-\d{2})", 50, True), (r"(?i)DATE[:\s]*([0-3]?\d[/\-][01]?\d[/\-]\d{2,4}|\d{4}-\d{2}-\d{2})", 20, True),
    (r"\b(20\d{2}-\d{2}-\d{2})\b", 5, True), (r"\b([0-3]?\d-[01]?\d-20\d{2})\b", 5, True),
    (r"\b([01]?\d/[0-3]?\d/20\d{2})\b", 4, False),
)
GENERIC_DATES = (r"(20\d{2}[-/]\d{2}[-/]\d{2})", r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})")
CLAIM_AMOUNTS = (r"REIMBURSABLE\s+TOTAL", r"TOTAL\s+CLAIM", r"AMOUNT\s+CLAIMED", r"TOTAL\s+DUE")
CLAIM_EXCLUDES = (r"ADVANCE", r"CASH\s+PAID", r"TIP", r"TAX")
CLAIM_CODES = (
    r"(?i)CLAIM\s*CODE(?:\s*:\s*|\s+)([A-Z0-9\-]+)", r"(?i)CLAIM\s*REF(?:\s*:\s*|\s+)([A-Z0-9\-]+)",
    r"(?i)EXPENSE\s*CODE(?:\s*:\s*|\s+)([A-Z0-9\-]+)",
)
SETTLEMENT_CODES = (
    r"(?i)CREDIT\s*NO(?:\s*:\s*|\s+)([A-Z0-9\-]+)", r"(?i)RECEIPT\s*NO(?:\s*:\s*|\s+)([A-Z0-9\-]+)",
    r"(?i)REFERENCE(?:\s*:\s*|\s+)([A-Z0-9\-]+)",
)
PURCHASE_WORDS = (r"(?i)PURCHASE\s+RECEIPT", r"(?i)TAX\s+INVOICE", r"(?i)STORE\s+RECEIPT")
CREDIT_WORDS = (r"(?i)CREDIT\s+NOTE", r"(?i)REFUND\s+ADJUSTMENT", r"(?i)CREDIT\s+MEMO")
PURCHASE_AMOUNTS = (r"GRAND\s+TOTAL", r"TOTAL\s+DUE", r"AMOUNT\s+DUE")
CREDIT_AMOUNTS = (r"CREDIT\s+AMOUNT", r"REFUND\s+TOTAL", r"TOTAL\s+CREDIT")
SETTLEMENT_EXCLUDES = (r"SUBTOTAL", r"TAX", r"DISCOUNT")
ITEM_SKIP = r"(?i)PROJECT\s*TOTAL|ITEM\s*DESCRIPTION|MEAS\.?\s*DATE|PROJECT:"
PROJECT_TOTALS = ((r"(?i)PROJECT\s*TOTAL", 50), (r"(?i)GRAND\s*TOTAL", 20), (r"(?i)\bTOTAL\b", 20))
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy")
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy")
YEAR_FIRST = ("yyyy/M/d", "yyyy-M-d")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), strip), lambda l: F.length(l) > 0)


def parse_day(text: Column, day_first: bool) -> Column:
    """First format that parses to a year from 2000 to 2035; look-alike letters count as digits."""
    v = F.translate(text, "OoIl ", "0011")
    order = (*DAY_FIRST, *MONTH_FIRST) if day_first else (*MONTH_FIRST, *DAY_FIRST)
    days = [F.try_to_timestamp(v, F.lit(f)).cast("date") for f in (*order, *YEAR_FIRST)]
    return F.coalesce(*[F.when(F.year(d).between(2000, 2035), d) for d in days])


def best_date(text: Column, patterns) -> Column:
    """Date of the highest priority pattern; earlier pattern and match win ties."""
    def hits(pattern, rank, priority, day_first):
        return F.transform(extract_all(text, pattern, 1), lambda m, i: F.struct(
            F.lit(priority).alias("p"), F.lit(-rank).alias("r"), (-i).alias("i"), parse_day(m, day_first).alias("d")))

    def best(found):
        return F.array_max(F.filter(F.concat(*found), lambda x: x["d"].isNotNull()))["d"]

    named = [hits(p, n, prio, first) for n, (p, prio, first) in enumerate(patterns)]
    generic = [hits(p, n, 1, True) for n, p in enumerate(GENERIC_DATES)]
    return F.coalesce(best(named), best(generic))


def _numbers(line: Column) -> Column:
    return F.transform(extract_all(line, MONEY, 1), lambda m: F.regexp_replace(m, r"[,\s]", "").try_cast("decimal(18,2)"))


def with_lines(pages: DataFrame) -> DataFrame:
    """Pages with their lines as a column, cut once and shared by every field."""
    return staged(pages, lines=lines_of(F.col("text")))


def amount_by_keywords(lines: Column, keywords, excludes=()) -> Column:
    """Amount next to the best keyword, on its line or the line below; else the largest amount."""
    skip = "(?iU)" + "|".join(excludes) if excludes else None
    open_ = lambda l: ~l.rlike(skip) if skip else F.lit(True)
    n = len(keywords)
    empty = F.array().cast("array<struct<p:int,v:decimal(18,2)>>")

    def candidates(line, i):
        priority = None
        for k, word in enumerate(keywords):
            hit = line.rlike("(?iU)" + word)
            priority = F.when(hit, n - k) if priority is None else priority.when(hit, n - k)
        own = _numbers(line)
        below = F.coalesce(_numbers(F.get(lines, i + 1)), F.array().cast("array<decimal(18,2)>"))
        last_two = F.slice(own, F.greatest(F.size(own) - 1, F.lit(1)), 2)
        return (
            F.when(priority.isNull() | ~open_(line), empty)
            .when(F.size(own) > 0, F.transform(last_two, lambda v: F.struct(priority.alias("p"), v.alias("v"))))
            .when(F.size(below) > 0, F.array(F.struct((priority - 1).alias("p"), F.element_at(below, -1).alias("v"))))
            .otherwise(empty))

    found = F.flatten(F.transform(lines, candidates))
    rest = F.flatten(F.transform(F.filter(lines, open_), _numbers))
    return F.coalesce(F.array_max(found)["v"], F.array_max(rest))


def reference_code(text: Column, patterns, year_part: bool = False) -> Column:
    """First matching code pattern, with look-alike letters fixed and a padded suffix."""
    raw = F.coalesce(*[non_empty(F.regexp_extract(text, p, 1)) for p in patterns])
    parts = F.split(F.regexp_replace(F.upper(raw), r"[^A-Z0-9\-]", ""), "-")

    def fix(part, i):
        digits = F.translate(part, "OIL", "011")
        if year_part:
            return F.when(i >= 1, digits).otherwise(part)
        return F.when((i >= 2) | ((i == 1) & part.rlike(r"\d")), digits).otherwise(part)

    fixed = F.transform(parts, fix)
    n = F.size(fixed)
    target = F.lit(2) if year_part else n - 1

    def finish(part, i):
        digits = F.regexp_replace(F.translate(part, "OIL", "011"), r"\D", "")
        out = F.when((n >= 3) & (i == target) & (F.length(digits) > 0), F.lpad(F.right(digits, F.lit(3)), 3, "0"))
        if year_part:
            out = out.when((n >= 3) & (i == 1) & (F.length(digits) >= 4), F.substring(digits, 1, 4))
        return out.otherwise(part)

    return F.when(raw.isNotNull(), F.array_join(F.transform(fixed, finish), "-"))


def claim_fields(pages: DataFrame) -> DataFrame:
    """Code, date and amount of each claim page. ``pages``: path, text."""
    t = F.col("text")
    return with_lines(pages).select("path", reference_code(t, CLAIM_CODES, year_part=True).alias("claim_code"),
                        best_date(t, CLAIM_DATES).alias("claim_date"),
                        amount_by_keywords(F.col("lines"), CLAIM_AMOUNTS, CLAIM_EXCLUDES).alias("amount"))


def settlement_events(pages: DataFrame) -> DataFrame:
    """Classified pages, the first page per reference by path over all cases; pages without one stay.

    ``pages``: case_id, path, text.
    """
    t = F.col("text")
    kind = F.when(matches_any(t, CREDIT_WORDS), "credit").when(matches_any(t, PURCHASE_WORDS), "purchase")
    code = reference_code(t, SETTLEMENT_CODES)
    lines = F.col("lines")
    d = staged(pages, document_type=kind).filter(F.col("document_type").isNotNull())
    d = staged(with_lines(d), _code=code, event_date=best_date(t, SETTLEMENT_DATES), amount=F.when(
        F.col("document_type") == "purchase", amount_by_keywords(lines, PURCHASE_AMOUNTS, SETTLEMENT_EXCLUDES))
        .otherwise(amount_by_keywords(lines, CREDIT_AMOUNTS, SETTLEMENT_EXCLUDES))).select(
        "case_id", "path", "document_type", F.when(F.length("_code") >= 4, F.col("_code")).alias("document_ref"), "event_date", "amount")
    # A page without a reference is its own group.
    key = F.coalesce(F.concat(F.lit("ref:"), F.col("document_ref")), F.concat(F.lit("page:"), F.col("path")))
    return first_rows(d.withColumn("_key", key), ["_key"], ["path"]).drop("_key")


def settlement_summary(events: DataFrame) -> DataFrame:
    """Purchases less credits and the latest date per case."""
    zero = F.lit(0).cast("decimal(18,2)")
    total = lambda k: F.coalesce(F.sum(F.when(F.col("document_type") == k, F.col("amount"))), zero)
    d = events.filter(F.col("amount").isNotNull() | F.col("event_date").isNotNull())
    return d.groupBy("case_id").agg(total("purchase").alias("purchase_total"), total("credit").alias("credit_total"),
                                    F.max("event_date").alias("latest_date")).withColumn(
        "net_amount", F.col("purchase_total") - F.col("credit_total"))


def line_items(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Priced lines split into description, quantity and unit price, once per page."""
    line = F.col("line")
    d = pages.select(*keys, F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).filter(
        line.contains("$") & ~line.rlike(ITEM_SKIP))
    prices = extract_all(line, r"\$?\s*(\d+(?:\.\d{2})?)", 1)
    price = F.element_at(prices, -1)
    # Everything before the last occurrence of the price.
    before = F.replace(F.expr("substring(line, 1, length(line) - length(price) - length(tail))"), F.lit("$"), F.lit(" "))
    d = d.filter(F.size(prices) > 0).withColumn("price", price).withColumn(
        "tail", F.expr("substring_index(line, price, -1)"))
    d = d.withColumn("prefix", before)
    qty = F.element_at(extract_all(F.col("prefix"), r"\b\d+(?:\.\d+)?\b"), -1)
    d = d.filter(F.size(extract_all(F.col("prefix"), r"\b\d+(?:\.\d+)?\b")) > 0).withColumn("qty", qty)
    desc = F.regexp_replace(squeeze(F.regexp_replace(F.col("_desc"), r"[^A-Za-z0-9\s\-()]", " ")), r"^[ -]+|[ -]+$", "")
    head_of = F.expr("substring(prefix, 1, length(prefix) - length(qty) - length(substring_index(prefix, qty, -1)))")
    d = d.withColumn("_desc", head_of).withColumn("item_description", desc).filter(F.length("item_description") > 0)
    plain = F.regexp_replace(F.regexp_replace("qty", r"(\.\d*?)0+$", "$1"), r"\.$", "")
    d = d.select(*keys, "pos", "item_description", F.when(F.col("qty").contains("."), plain).otherwise(F.col("qty")).alias("quantity"),
                 F.col("price").cast("decimal(18,2)").cast("string").alias("unit_price"))
    return first_rows(d.withColumn("_k", F.lower("item_description")), [*keys, "_k", "quantity", "unit_price"], ["pos"]).drop("_k")


def page_total(lines: Column) -> Column:
    """Total of a page: project total first, then any total, then the line below one."""
    empty = F.array().cast("array<struct<p:int,i:int,v:decimal(18,2)>>")

    def candidates(line, i):
        hit = matches_any(line, [p for p, _ in PROJECT_TOTALS])
        own, below = _numbers(line), F.coalesce(_numbers(F.get(lines, i + 1)), F.array().cast("array<decimal(18,2)>"))
        rank = F.when(line.rlike(PROJECT_TOTALS[0][0]), PROJECT_TOTALS[0][1]).otherwise(PROJECT_TOTALS[1][1])
        return (F.when(~hit, empty)
                .when(F.size(own) > 0, F.array(F.struct(rank.alias("p"), (-i).alias("i"), F.element_at(own, -1).alias("v"))))
                .when(F.size(below) > 0, F.array(F.struct(F.lit(10).alias("p"), (-i).alias("i"), F.element_at(below, -1).alias("v"))))
                .otherwise(empty))

    return F.array_max(F.flatten(F.transform(lines, candidates)))["v"]


def project_summary(pages: DataFrame) -> DataFrame:
    """The first page of each project gives its date and total. ``pages``: path, project_code, text."""
    d = with_lines(pages.filter(F.length("project_code") > 0)).select(
        "project_code", "path", best_date(F.col("text"), SETTLEMENT_DATES).alias("project_date"), page_total(F.col("lines")).alias("total_amount"))
    return first_rows(d, ["project_code"], ["path"])


def validated_references(rows: DataFrame, known: DataFrame, code: str, pos: str, values: list[str],
                         drop_repeats: bool = False) -> DataFrame:
    """Unknown codes become null; later copies of a known code lose all values, or the row.

    ``known``: column ``code``. Which copy is first is one aggregate per code, so a code that
    repeats in a third of all rows is no problem.
    """
    k = known.select(F.upper(F.trim("code")).alias(code), F.lit(True).alias("_known")).distinct()
    d = rows.join(k, code, "left").withColumn("_code", F.when(F.col("_known"), F.col(code)))
    firsts = d.filter(F.col("_code").isNotNull()).groupBy("_code").agg(F.min(pos).alias("_first"))
    d = d.join(firsts, "_code", "left")
    copy = F.coalesce(F.col(pos) != F.col("_first"), F.lit(False))
    if drop_repeats:
        return d.filter(F.col("_code").isNotNull() & ~copy).select(*rows.columns)
    rest = [c for c in rows.columns if c not in (code, *values)]
    return d.select(*rest, F.when(~copy, F.col("_code")).alias(code), *[F.when(~copy, F.col(v)).alias(v) for v in values])
