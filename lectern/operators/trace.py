"""Trace events: pairing of spans, durations, and how many run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_spans(events: DataFrame) -> DataFrame:
    """events (event start|end, span_id, name, kind, ts) -> span_id, name, kind, start, end, ms; spans without both ends are left out.

    One aggregation by span: no join, and a span's attributes come from its
    end where that has them.
    """
    at = lambda e, c: F.max(F.when(F.col("event") == e, F.col(c)))
    out = events.groupBy("span_id").agg(
        at("start", "ts").alias("start"), at("end", "ts").alias("end"),
        F.coalesce(at("end", "name"), at("start", "name")).alias("name"), F.coalesce(at("end", "kind"), at("start", "kind")).alias("kind"),
    )
    return out.filter("start IS NOT NULL AND end IS NOT NULL")


def span_stats(spans: DataFrame, ms: str = "ms") -> DataFrame:
    """By kind and name: how many spans, and their average, total and longest time."""
    return spans.groupBy("kind", "name").agg(F.count("*").alias("n"), F.avg(ms).alias(f"avg_{ms}"), F.sum(ms).alias(f"total_{ms}"), F.max(ms).alias(f"max_{ms}"))


def peak_concurrency(spans: DataFrame, by: list[str] | None = None, start: str = "start", end: str = "end") -> DataFrame:
    """Most spans open at one time, for each key; a span that starts when another ends counts beside it.

    Steps of one time are summed first.  Without a key, times are cut into
    ranges: each range's running sum starts from the total of those before
    it, so no task sorts all of them.
    """
    keys = by or []
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col(end).alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("p"))
    steps = ends.groupBy(*keys, "p.t").agg(F.sum("p.up").alias("up"), F.sum("p.down").alias("down"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        return steps.withColumn("open", F.coalesce(F.sum(F.col("up") - F.col("down")).over(w), F.lit(0)) + F.col("up")).groupBy(*keys).agg(F.max("open").cast("long").alias("peak"))
    day = F.date_trunc("hour", "t") if dict(steps.dtypes)["t"].startswith("timestamp") else F.floor(F.col("t") / 3600)
    steps = steps.withColumn("part", day)
    totals = steps.groupBy("part").agg(F.sum(F.col("up") - F.col("down")).alias("net"))
    totals = totals.select("part", F.coalesce(F.sum("net").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("part").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    out = steps.withColumn("open", F.coalesce(F.sum(F.col("up") - F.col("down")).over(w), F.lit(0)) + F.col("up"))
    return out.groupBy("part").agg(F.max("open").alias("high")).join(totals, "part").agg(F.max(F.col("high") + F.col("base")).cast("long").alias("peak"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert by the latest write, as one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], created: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; the creation time of the first stays."""
    both = old.unionByName(new)
    out = latest(both, keys, order)
    if created:
        out = out.drop(created).join(both.groupBy(*keys).agg(F.min(created).alias(created)), keys)
    return out.select(*old.columns)


def enclosing(inner: DataFrame, outer: DataFrame, by: str, name: str) -> DataFrame:
    """inner (by, id, start, end) with `name`: the id of the innermost outer span (by, id, start, end) around each, null if none is.

    Whole times.  An outer span lies in the one or two bins of its own size
    class that it touches, and an inner span asks every size class for the bin
    in which it starts; so both meet by equality, whatever their lengths.  Of
    several around it the one that starts last counts, then the shorter, then
    the lesser id.
    """
    level = F.ceil(F.log2((F.col("end") - F.col("start") + 1).cast("double"))).cast("int")
    bin_of = lambda t, k: F.floor(t / F.pow(F.lit(2.0), k)).cast("long")
    o = outer.filter("start <= end").select(by, F.col("id").alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"), level.alias("_level"))
    o = o.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col("_start"), F.col("_level")), bin_of(F.col("_end"), F.col("_level"))))))
    levels = F.explode(F.sequence(F.lit(0), F.lit(63)))
    used = o.select("_level").distinct()  # 64 at most
    i = inner.select(by, "id", "start", "end", levels.alias("_level")).join(F.broadcast(used), "_level").withColumn("_bin", bin_of(F.col("start"), F.col("_level")))
    met = i.join(o, [by, "_level", "_bin"]).filter("_start <= start AND _end >= end AND NOT (id = _id)")
    best = met.groupBy(by, "id").agg(F.min_by("_id", F.struct(-F.col("_start"), "_end", "_id")).alias(name))
    return inner.join(best, [by, "id"], "left")


def paper_table(spans: DataFrame) -> DataFrame:
    """spans (paper_id, id, kind, name, status, start, end, tokens) -> a row a paper and phase: what ran in it.

    Tools count for the phase around them, by way of no other span; a phase
    that ran several times is one row, and what lies in no phase stands under a
    null one.  agent_tools counts the tools within an agent.
    """
    of = lambda k: spans.filter(F.col("kind") == k)
    phases = of("phase")
    named = phases.select("paper_id", F.col("id").alias("phase_id"), F.col("name").alias("phase"))
    tools = enclosing(enclosing(of("tool"), phases, "paper_id", "phase_id"), of("agent"), "paper_id", "agent_id").join(named, ["paper_id", "phase_id"], "left")
    agents = enclosing(of("agent"), phases, "paper_id", "phase_id").join(named, ["paper_id", "phase_id"], "left")
    ms = (F.col("end") - F.col("start")).cast("long")
    zero = F.lit(0).cast("long")
    part = lambda d, **c: d.select("paper_id", "phase", *[c.get(n, zero).alias(n) for n in ("phases", "ms", "failed", "agents", "tools", "agent_tools", "tool_ms", "tokens")])
    one = F.lit(1).cast("long")
    failed = (F.col("status") != "success").cast("long")
    rows = part(phases.withColumn("phase", F.col("name")), phases=one, ms=ms, failed=failed).unionByName(part(agents, agents=one, failed=failed))
    rows = rows.unionByName(part(tools, tools=one, agent_tools=F.col("agent_id").isNotNull().cast("long"), tool_ms=ms, tokens=F.coalesce("tokens", zero), failed=failed))
    return rows.groupBy("paper_id", "phase").agg(*[F.sum(c).alias(c) for c in ("phases", "ms", "failed", "agents", "tools", "agent_tools", "tool_ms", "tokens")])


def progress(papers: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """How far a batch is: papers, and how many of them are completed, failed, timed out and neither yet."""
    n = lambda *kinds: F.sum(F.col(status).isin(*kinds).cast("long"))
    done = n("completed", "error", "timeout")
    return papers.groupBy(*by).agg(F.count("*").alias("total"), n("completed").alias("completed"), n("error").alias("errors"), n("timeout").alias("timeouts"), (F.count("*") - F.coalesce(done, F.lit(0))).alias("running"))
