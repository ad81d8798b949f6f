"""Mixing sources to target weights by capped water-filling.

A source that would have to be repeated more often than ``max_epochs`` to
reach its share is held there, and what it leaves over goes to the others in
proportion to their weights, until no source is over. Documents are then
repeated whole times, and the fractional time by a seeded hash of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._groups import free
from pagewright.plans.cut import cut

#: Sources up to which their rates are broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000
#: Production targets: what isn't named weighs 1.
WEIGHTS = {"src0": 4.0, "src3": 6.0, "src7": 2.0, "src11": 3.0}
MAX_EPOCHS, SEED = 4.0, 17


def water_fill(sizes: dict[str | None, float], weights: dict[str | None, float], budget: float, max_epochs: float, default: float = 1.0) -> dict[str | None, float]:
    """Epochs of each source.

    ``budget`` is spread in proportion to the weights over sources of
    ``sizes``; no source gets over ``max_epochs`` times its size. A source
    without size or weight gets 0. If every source is at its cap, the rest of
    the budget stays unspent.
    """
    w = {s: max(0.0, float(weights.get(s, default))) for s in sizes}
    open_, given, left = {s for s in sizes if sizes[s] > 0 and w[s] > 0}, dict.fromkeys(sizes, 0.0), float(budget)
    while open_:
        total = sum(w[s] for s in sorted(open_, key=str))
        over = [s for s in open_ if left * w[s] / total > max_epochs * sizes[s]]
        if not over:
            for s in open_:
                given[s] = left * w[s] / total / sizes[s]
            break
        for s in over:
            given[s] = float(max_epochs)
        left -= sum(max_epochs * sizes[s] for s in sorted(over, key=str))
        open_ -= set(over)
    return given


def unit(seed: int, doc_id: str = "doc_id") -> str:
    """SQL for a number in [0, 1) from seed and document, the same in every engine."""
    return f"cast(conv(substr(md5(concat('{seed}:', coalesce(cast({doc_id} as string), ''))), 1, 12), 16, 10) as double) / 281474976710656.0"


def _size() -> F.Column:
    return F.coalesce(F.length("text"), F.lit(0))


def _many_sources(sizes: DataFrame, weights: dict[str | None, float], budget_share: float, max_epochs: float) -> DataFrame:
    """The same rates for more sources than the driver should hold, as SQL.

    Sorted by size over weight, those at their cap come first: the source
    after them is the first whose size can take its share of what is left.
    """
    spark = sizes.sparkSession
    named = [(s, float(w)) for s, w in weights.items()]
    w = F.broadcast(spark.createDataFrame(named, "_ws string, _w double")) if named else None
    x = sizes.withColumn("_w", F.lit(1.0)) if w is None else sizes.join(w, F.col("source").eqNullSafe(F.col("_ws")), "left").select("source", "size", F.coalesce("_w", F.lit(1.0)).alias("_w"))
    x = cut(x.where("size > 0 and _w > 0"))  # read twice below
    totals = x.agg(F.sum("size").alias("_all"), F.sum("_w").alias("_weights"))
    ordered = x.crossJoin(F.broadcast(totals))  # one row
    return spark.sql(
        f"""
        with a as (
          select *, coalesce(sum(size) over (order by size / _w, source rows between unbounded preceding and 1 preceding), 0) * {float(max_epochs)} as held,
                 _weights - coalesce(sum(_w) over (order by size / _w, source rows between unbounded preceding and 1 preceding), 0) as open
          from {{sources}}
        ), b as (select *, (_all * {float(budget_share)} - held) * _w / open > {float(max_epochs)} * size as over from a)
        , c as (select min(case when not over then struct(size / _w as r, source, held, open) end) as first from b)
        select source, case when first is null or struct(size / _w, source) < struct(first.r, first.source) then {float(max_epochs)}
               else (_all * {float(budget_share)} - first.held) / first.open * _w / size end as epochs
        from b cross join c
        """,
        sources=ordered,
    )


def rates(docs: DataFrame, weights: dict[str | None, float], budget_share: float = 1.0, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, epochs``, from the characters of every source.

    ``budget_share`` is the characters wanted, as a share of all there are.
    """
    sizes = docs.groupBy("source").agg(F.sum(_size()).alias("size"))
    rows = sizes.limit(MAX_BROADCAST + 1).collect()
    if len(rows) > MAX_BROADCAST:
        return _many_sources(sizes, weights, budget_share, max_epochs)
    found = {r["source"]: float(r["size"]) for r in rows}
    given = water_fill(found, weights, budget_share * sum(found.values()), max_epochs)
    return F.broadcast(docs.sparkSession.createDataFrame([*given.items()], "source string, epochs double"))


def mix(docs: DataFrame, weights: dict[str | None, float], budget_share: float = 1.0, max_epochs: float = MAX_EPOCHS, seed: int = SEED, number: str = "copy") -> DataFrame:
    """The rows of documents, each as often as its source's epochs say, with ``copy`` (or what ``number`` says) from 0.

    A document of a source with e epochs comes floor(e) times, and once more
    where its number in [0, 1) is under the rest. A null source is a source of
    its own (weighted under ``None``); null and empty texts have size 0 but are
    repeated like the other documents of their source; repeated rows get the
    same number, as do null ids. A source of no characters at all gives
    nothing. Column names of the table other than the three used are free,
    except that of the number, which is replaced. An empty table gives no rows.
    """
    name, epochs, times = (free(x, docs.columns) for x in ("_mix_source", "_mix_epochs", "_mix_times"))
    r = rates(docs, weights, budget_share, max_epochs).select(F.col("source").alias(name), F.col("epochs").alias(epochs))
    kept = [c for c in docs.columns if c.lower() != number.lower()]
    drawn = F.expr(f"cast(floor({epochs}) as int) + case when {unit(seed)} < {epochs} - floor({epochs}) then 1 else 0 end")
    joined = docs.join(r, F.col("source").eqNullSafe(F.col(name))).withColumn(times, drawn).where(f"{times} > 0")
    return joined.select(*kept, F.explode(F.expr(f"sequence(0, {times} - 1)")).alias(number))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document drawn, once a row, with its source and copy number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, WEIGHTS).select("doc_id", "source", "copy")


OP3_SQL = f"""
with recursive sizes as (
  select source, sum(coalesce(length(text), 0))::double as size,
         case source {" ".join(f"when '{s}' then {w}" for s, w in WEIGHTS.items())} else 1.0 end::double as w
  from documents group by source
), live as (select * from sizes where size > 0)
, ordered as (
  select *, coalesce(sum(size) over before, 0) * {MAX_EPOCHS} as held, sum(w) over () - coalesce(sum(w) over before, 0) as open, sum(size) over () as total
  from live window before as (order by size / w, source rows between unbounded preceding and 1 preceding)
), flagged as (select *, (total - held) * w / open > {MAX_EPOCHS} * size as over_cap from ordered)
, stop as (select held, open, size / w as r, source as s from flagged where not over_cap order by size / w, source limit 1)
, rates as (
  select f.source, case when stop.s is null or (f.size / f.w, f.source) < (stop.r, stop.s) then {MAX_EPOCHS}::double
         else (f.total - stop.held) / stop.open * f.w / f.size end as epochs
  from flagged f left join stop on true
), drawn as (
  select d.doc_id, d.source, floor(epochs)::int + case when ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::varchar, '')), 1, 12))::bigint / 281474976710656.0 < epochs - floor(epochs) then 1 else 0 end as n
  from documents d join rates r on d.source is not distinct from r.source
)
select doc_id, source, unnest(range(n))::int as "copy" from drawn where n > 0
"""
