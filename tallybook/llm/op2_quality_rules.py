"""Quality rules: cutoffs that follow each language and source instead of fixed ones.

Base counts and the verdict are DataFrame functions only. The metrics of the
documents that pass the base rules go into mergeable quantile sketches: cells
of a logarithmic histogram (the leading six bits of a value, so a relative
error below 1/32), counted by language, source and metric. Sketches merge by
adding counts: a source with too few documents takes its language's sketch,
and a language with too few takes the whole corpus's. A document is rejected
where a metric lies beyond the upper fence of its group; documents are joined
with the fences by language and source.

Defined results: null or empty text has no words and fails the base rules;
null language or source is a group of its own; ties and repeated rows count
as often as they occur; other columns pass through whatever their names (they
travel in one struct), and an input column named like a result column is
replaced. Each fence can reject what the base rules pass: duplicate lines are
measured by lines, and the margins of duplicate lines and repeats are the
group's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.runtime import durable, small_side, without

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Metric: (SQL of its value in thousandths, what a fence leaves free above the quantiles' spread; None: up to the end of
#: the cell of the group's own 99th percentile).
METRICS = {
    "symbol_rate": ("n_symbols * 1000 div greatest(word_chars, 1)", 50),
    "dup_line_rate": ("n_dup_lines * 1000 div greatest(n_lines, 1)", None),
    "repeat_rate": ("n_repeat_words * 1000 div greatest(n_words, 1)", None),
    "word_length": ("word_chars * 1000 div greatest(n_words, 1)", 4000),
}
MIN_GROUP = 200
SPREAD = 3


def quality_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and n_lines (those with a word)."""
    docs = without(docs, [*COUNTS, "n_lines"])
    own = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("own")
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    step = docs.select(own, words.alias("_w"), text.alias("_t"))

    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    plain = ~F.col("_t").rlike("[#*$%&|<>]")
    step = step.select(
        "own",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.when(plain, F.lit(0)).otherwise(F.length("_t") - F.length(F.translate(F.col("_t"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr(F.col("_t"), "\n") == 0, F.lit(0)).otherwise(F.aggregate(F.array(lines), F.lit(0), lambda a, x: F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
        F.when(F.instr(F.col("_t"), "\n") == 0, F.least(F.size("_w"), F.lit(1))).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    at = lambda i, k: F.get(F.col("_h"), i + F.lit(k))
    windows = F.when(F.size("_h") >= 5, F.transform(F.sequence(F.lit(0), F.size("_h") - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))).otherwise(F.array().cast("array<long>"))
    kept = ["own", *COUNTS[:4], "n_lines"]
    step = step.select(*kept, windows.alias("_w"))
    # only texts with a repeated window pay for finding where it is
    paired = F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select(*kept, paired.alias("_s"))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    starts = F.filter(F.transform("_s", lambda x, k: F.when(same(x, F.get("_s", k - 1)) | same(x, F.get("_s", k + 1)), x["i"])), lambda p: p.isNotNull())
    step = step.select(*kept, F.array_sort(starts).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, n: a + n)
    # one struct, unfolded again: a later filter on a count cannot be pushed into the array functions, which would run once for each mention
    counts = F.struct(*COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")
    step = step.select("own", F.inline(F.array(counts))).select("own.*", *COUNTS[:5], "n_lines")
    return step.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _cell(value: Column) -> Column:
    """The least value with the same leading six bits."""
    step = F.expr("shiftleft(1L, greatest(0, length(bin(value)) - 6))")
    return value - value % step


def sketch(counted: DataFrame) -> DataFrame:
    """Sketch cells (lang, source, metric, cell, n) of the documents that pass the base rules."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(sql).alias("value")) for m, (sql, _) in METRICS.items()])
    long = counted.filter(~F.col("base_failed")).select("lang", "source", F.inline(values))
    return long.groupBy("lang", "source", "metric", _cell(F.col("value")).alias("cell")).agg(F.count("*").alias("n"))


def fences(cells: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """(lang, source, and for each metric its upper fence), from the finest sketch with enough documents."""
    levels = {"own": ["lang", "source", "metric"], "lang": ["lang", "metric"], "all": ["metric"]}
    groups = cells.select("lang", "source", "metric").distinct()
    for name, keys in levels.items():
        merged = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
        below = merged.selectExpr(*keys, "cell", "sum(n) over (partition by " + ", ".join(keys) + " order by cell) as upto", "sum(n) over (partition by " + ", ".join(keys) + ") as total")
        at = below.groupBy(*keys).agg(F.max("total").alias("total"), *[F.min(F.expr(f"case when upto * 100 >= total * {q} then cell end")).alias(f"q{q}") for q in (50, 75, 99)])
        fence = F.expr(f"q75 + {spread} * (q75 - q50)")
        top = F.expr("q99 + shiftleft(1L, greatest(0, length(bin(q99)) - 6)) - 1")
        fence = F.when(F.col("metric").isin([m for m, (_, f) in METRICS.items() if f is None]), F.greatest(fence, top)).otherwise(fence)
        level = at.select(*[F.col(k).alias(f"_{k}") for k in keys], F.when(F.col("total") >= (0 if name == "all" else min_group), fence).alias(f"fence_{name}"))
        on = [groups[k].eqNullSafe(level[f"_{k}"]) for k in keys]
        groups = groups.join(level, on, "left").drop(*[f"_{k}" for k in keys])
    fence = F.coalesce("fence_own", "fence_lang", "fence_all")
    free = F.create_map(*[F.lit(x) for m, (_, f) in METRICS.items() for x in (m, f or 0)])
    return groups.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, fence + F.element_at(free, F.col("metric")))).alias(f"fence_{m}") for m in METRICS])


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with kept and the metrics that put a document beyond its group's fences."""
    values = [F.expr(sql).alias(m) for m, (sql, _) in METRICS.items()]
    rows = counted.select(F.struct("*").alias("own"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("base_failed").alias("_failed"), *values)
    joined = rows.join(limits, rows["_lang"].eqNullSafe(limits["lang"]) & rows["_source"].eqNullSafe(limits["source"]), "left")
    over = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"fence_{m}"), F.lit(m)) for m in METRICS]))
    return joined.select("own.*", over.alias("beyond"), (~F.col("_failed") & (F.size(over) == 0)).alias("kept"))


def quality_rules(docs: DataFrame, text_col: str = "text", min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """docs with the base counts, n_lines, base_failed, beyond (metrics over the fence) and kept.

    The texts are read twice, once for the sketches and once for the verdicts,
    which costs less than carrying texts through a shuffle. Needs the columns
    lang and source.
    """
    docs = without(docs, ["kept", "beyond"])
    counted = quality_counts(docs, text_col)
    return judge(counted, small_side(fences(durable(sketch(counted)), min_group, spread)))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    counted = durable(quality_counts(docs).drop("text"))  # short rows: counted once
    judged = judge(counted, small_side(fences(durable(sketch(counted)))))
    return judged.select("doc_id", *COUNTS, "n_lines", F.array_join("beyond", "|").alias("beyond"), "kept")


_RATE = {m: sql.replace(" div ", " // ") for m, (sql, _) in METRICS.items()}
ORACLE = f"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
pos as (select rid, unnest(range(1, len(w) - 3)) as p, w from d where len(w) >= 5),
win as (select rid, p, w[p:p + 4] as g from pos),
rep as (select rid, p from win qualify count(*) over (partition by rid, g) > 1),
cov as (select rid, count(distinct q) as n from (select rid, unnest(range(p, p + 5)) as q from rep) group by rid),
lin as (select rid, count(*) - count(distinct l) as n, count(*) as n_lines from (select rid, unnest(string_split(t, chr(10))) as l from d)
        where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by rid),
c as (
  select d.rid, doc_id, lang, source, len(w)::bigint as n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(lin.n, 0)::bigint as n_dup_lines, coalesce(lin.n_lines, 0)::bigint as n_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from d left join lin using (rid) left join cov using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
v as ({" union all ".join(f"select lang, source, '{m}' as metric, {sql} as value from b where not base_failed" for m, sql in _RATE.items())}),
cells as (select lang, source, metric, value - value % (1::bigint << greatest(0, length(bin(value)) - 6)::integer) as cell, count(*) as n from v group by all),
lv as (
  select 0 as level, lang, source, metric, cell, n from cells
  union all select 1, lang, null, metric, cell, sum(n) from cells group by lang, metric, cell
  union all select 2, null, null, metric, cell, sum(n) from cells group by metric, cell),
cum as (select *, sum(n) over (partition by level, lang, source, metric order by cell) as upto,
               sum(n) over (partition by level, lang, source, metric) as total from lv),
q as (
  select level, lang, source, metric, max(total) as total, {", ".join(f"min(case when upto * 100 >= total * {k} then cell end) as q{k}" for k in (50, 75, 99))}
  from cum group by level, lang, source, metric),
f as (
  select level, lang, source, metric, total,
         case metric {" ".join(f"when '{m}' then q75 + {SPREAD} * (q75 - q50) + {free}" for m, (_, free) in METRICS.items() if free is not None)}
              else greatest(q75 + {SPREAD} * (q75 - q50), q99 + (1::bigint << greatest(0, length(bin(q99)) - 6)::integer) - 1) end as fence
  from q),
g as (
  select k.lang, k.source, k.metric, coalesce(case when f0.total >= {MIN_GROUP} then f0.fence end, case when f1.total >= {MIN_GROUP} then f1.fence end, f2.fence) as fence
  from (select distinct lang, source, metric from cells) k
  join f f0 on f0.level = 0 and f0.lang is not distinct from k.lang and f0.source is not distinct from k.source and f0.metric = k.metric
  join f f1 on f1.level = 1 and f1.lang is not distinct from k.lang and f1.metric = k.metric
  join f f2 on f2.level = 2 and f2.metric = k.metric),
e as (
  select b.*, coalesce((select string_agg(metric, '|' order by list_position([{", ".join(f"'{m}'" for m in METRICS)}], metric)) from g where g.lang is not distinct from b.lang and g.source is not distinct from b.source and
         case g.metric {" ".join(f"when '{m}' then {sql}" for m, sql in _RATE.items())} end > g.fence), '') as beyond
  from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, beyond, not base_failed and beyond = '' as kept
from e
"""
