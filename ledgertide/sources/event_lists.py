"""Event lists: every item checked against the rules, with each problem as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SESSIONS = ("before_open", "during", "after_close", "unknown")
GUIDANCE = ("raised", "maintained", "lowered", "none")
CATEGORIES = ("company", "earnings", "industry", "market", "macro", "policy", "geopolitical", "other")
TICKER = r"^[A-Z0-9^][A-Z0-9.^=\-]{0,19}$"
CONTEXT_ITEMS, CONTEXT_LIMIT, SUMMARY_CHARS, SUMMARY_LIMIT = 8, 30, 300, 2000

ITEM = ("ticker STRING, date STRING, session STRING, name STRING, fiscal_year STRING, fiscal_quarter STRING, uncertain STRING, note STRING, "
        "earnings STRUCT<eps_actual: STRING, eps_estimate: STRING, revenue_actual: STRING, revenue_estimate: STRING, guidance: STRING>, "
        "context ARRAY<STRUCT<date: STRING, category: STRING, title: STRING, summary: STRING, source: STRING, url: STRING, major: STRING>>")


def read_event_list(lists: DataFrame, key: str, document: str = "value") -> DataFrame:
    """(key, item, fields...) of event lists: a JSON array, or an object with an ``events`` array."""
    body = F.regexp_replace(F.trim(F.col(document)), r"(?s)^```[a-zA-Z]*\s*\n(.*?)\n?```$", "$1")
    array = F.when(body.startswith("["), body).otherwise(F.get_json_object(body, "$.events"))
    return lists.select(F.col(key), F.posexplode(F.from_json(array, f"array<struct<{_struct()}>>")).alias("pos", "e")).select(
        key, (F.col("pos") + 1).alias("item"), "e.*")


def _struct() -> str:
    """ITEM with the ':' separators a nested struct needs."""
    out, depth = [], 0
    for word in ITEM.split(" "):
        out.append(word + ":" if depth == 0 and not word.endswith((",", ">", ":")) and word.islower() else word)
        depth += word.count("<") - word.count(">")
    return " ".join(out)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _day(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def check_events(items: DataFrame, key: str, kind: str, window: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events of lists without errors, issues).

    Issues: key, item, field, level (error / warning), code. Each rule is one column; duplicates and
    repeated fiscal quarters come from the first such item of a list, not from comparing items pairwise.
    Items are read once and shuffled once, by list; all that is compared lies together then and is only ordered again.
    """
    earnings = kind == "earnings"
    day, year, quarter = _day(F.col("date")), F.col("fiscal_year").try_cast("int"), F.col("fiscal_quarter").try_cast("int")
    stated = F.lit(earnings) | F.col("fiscal_year").isNotNull() | F.col("fiscal_quarter").isNotNull()
    ticker = F.upper(F.trim("ticker"))
    figures = [F.when(F.col(f"earnings.{f}").isNotNull() & F.col(f"earnings.{f}").try_cast("double").isNull(), F.lit(f"earnings.{f}")) for f in
               ("eps_actual", "eps_estimate", "revenue_actual", "revenue_estimate")]
    negative = [F.when(F.col(f"earnings.{f}").try_cast("double") < 0, F.lit(f"earnings.{f}")) for f in ("revenue_actual", "revenue_estimate")]
    rules: list[tuple[str, str, str, Column]] = [
        ("error", "ticker", "ticker_missing", _blank(F.col("ticker"))), ("error", "ticker", "ticker_invalid", ~_blank(F.col("ticker")) & ~ticker.rlike(TICKER)),
        ("error", "date", "date_invalid", day.isNull()), ("error", "date", "date_too_early", F.year(day) < 1990),
        ("error", "session", "session_invalid", ~F.coalesce(F.col("session").isin(*SESSIONS), F.lit(False))),
        ("error", "name", "name_missing", _blank(F.col("name"))), ("error", "name", "name_too_long", F.length("name") > 200),
        ("error", "fiscal_year", "fiscal_year_invalid", stated & ~F.coalesce(year.between(1990, 2100), F.lit(False))),
        ("error", "fiscal_quarter", "fiscal_quarter_invalid", stated & ~F.coalesce(quarter.between(1, 4), F.lit(False))),
        ("error", "note", "note_too_long", F.length("note") > 1000), ("error", "uncertain", "boolean_required", F.col("uncertain").isNotNull() & ~F.col("uncertain").isin("true", "false")),
        ("error", "earnings", "earnings_custom", F.lit(not earnings) & F.col("earnings").isNotNull()),
        ("error", "earnings", "number_required", F.coalesce(*figures).isNotNull()), ("error", "earnings", "revenue_negative", F.coalesce(*negative).isNotNull()),
        ("error", "earnings", "guidance_invalid", F.col("earnings.guidance").isNotNull() & ~F.col("earnings.guidance").isin(*GUIDANCE)),
        ("error", "context", "context_limit", F.size("context") > CONTEXT_LIMIT), ("warning", "context", "context_too_many", F.size("context").between(CONTEXT_ITEMS + 1, CONTEXT_LIMIT)),
        ("error", "context", "context_date", F.exists("context", lambda c: _day(c["date"]).isNull())),
        ("error", "context", "context_category", F.exists("context", lambda c: ~F.coalesce(c["category"].isin(*CATEGORIES), F.lit(False)))),
        ("error", "context", "context_title", F.exists("context", lambda c: _blank(c["title"]) | (F.length(c["title"]) > 200))),
        ("error", "context", "summary_too_long", F.exists("context", lambda c: F.length(c["summary"]) > SUMMARY_LIMIT)),
        ("error", "context", "url_invalid", F.exists("context", lambda c: ~_blank(c["url"]) & ~c["url"].rlike(r"(?i)^https?://[^\s/$.?#][^\s]*$"))),
        ("warning", "context", "summary_long", F.exists("context", lambda c: F.length(c["summary"]).between(SUMMARY_CHARS + 1, SUMMARY_LIMIT))),
        ("warning", "context", "source_missing", F.exists("context", lambda c: _blank(c["source"]))), ("warning", "context", "url_missing", F.exists("context", lambda c: _blank(c["url"]))),
        ("warning", "uncertain", "uncertain", F.col("uncertain") == "true"),
    ]
    if window is not None:
        rules.append(("warning", "context", "context_outside", F.exists(
            "context", lambda c: ~_day(c["date"]).between(F.date_sub(day, window[0]), F.date_add(day, window[1])))))
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(level).alias("level"), F.lit(code).alias("code")))
                                      for level, field, code, rule in rules]))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: merged by their compressed bytes, few tasks would order most rows
    own = ~F.exists("_issues", lambda i: i["level"] == "error")
    checked = items.withColumn("_issues", found).withColumns({"_own": own, "_t": ticker, "_n": F.lower(F.trim("name"))}).repartition(tasks, key)
    # A repeat is a clean item after a clean one like it. Lists without a key are no one list.
    later = lambda *by: F.col("_own") & F.col(key).isNotNull() & (
        F.col("item") > F.min(F.when(F.col("_own"), F.col("item"))).over(Window.partitionBy(key, *by)))
    repeats = [("_event", "item", "duplicate_event", ("_t", "date", "_n"))]
    if earnings:
        repeats.append(("_quarter", "fiscal_quarter", "duplicate_quarter", ("_t", "fiscal_year", "fiscal_quarter")))
    marked = checked
    for flag, _, _, by in repeats:
        marked = marked.withColumn(flag, F.coalesce(later(*by), F.lit(False)))
    repeated = F.array_compact(F.array(*[F.when(F.col(flag), F.struct(F.lit(field).alias("field"), F.lit("error").alias("level"), F.lit(code).alias("code")))
                                         for flag, field, code, _ in repeats]))
    issues = marked.select(key, "item", F.explode(F.concat("_issues", repeated)).alias("i")).select(key, "item", "i.field", "i.level", "i.code")
    faulty = ~F.col("_own")
    for flag, *_ in repeats:
        faulty = faulty | F.col(flag)
    broken = F.max(faulty).over(Window.partitionBy(key)) & F.col(key).isNotNull()
    events = marked.withColumn("_broken", broken).where("_own AND NOT _broken").select(
        key, "item", F.col("_t").alias("ticker"), F.to_date("date").alias("event_date"), "session", F.trim("name").alias("name"), F.col("fiscal_year").try_cast("int").alias("fiscal_year"),
        F.col("fiscal_quarter").try_cast("int").alias("fiscal_quarter"), F.coalesce(F.col("uncertain") == "true", F.lit(False)).alias("uncertain"), "note", "earnings", "context")
    return events, issues
