"""Joins."""

from pyspark.sql import functions as F

from registry.base import query
from registry.scans import EXCL
from tickloom.functions import cross
from tickloom.functions.expr import US, day_of
from tickloom.operators import book as B
from tickloom.operators import dates as D
from tickloom.operators import grid as G
from tickloom.operators import profit as P
from tickloom.operators import report as R
from tickloom.plans import repo_rate as RR
from tickloom.sources.sinks import stage


@query("join_roles", "ep:i d:d ctd_bid_price:f ctd_ask_price:f fut_bid_price:f fut_ask_price:f", """
       SELECT c.ep, c.d, c.l1_bid_price AS ctd_bid_price, c.l1_ask_price AS ctd_ask_price, f.l1_bid_price AS fut_bid_price, f.l1_ask_price AS fut_ask_price
       FROM grid5 c JOIN grid5 f ON c.ep = f.ep WHERE c.role = 'ctd' AND f.role = 'fut'""")
def _(t):
    return G.join_roles(t.grid5)


@query("align_daily", "role:s ep:i cf:f isin:s", "SELECT role, ep, cf, isin FROM quotes1 q LEFT JOIN daily_cf k ON k.d = q.d")
def _(t):
    return G.align_daily(t.quotes1.select("role", "d", "ep"), t.daily_cf)


@query("join_outer_features", "ep:i target:f feature:f", """
       SELECT COALESCE(a.ep, b.ep) AS ep, target, feature FROM (SELECT ep, l1_ask_price AS target FROM grid5 WHERE role = 'ctd') a
       FULL JOIN (SELECT ep, l1_bid_size AS feature FROM grid5 WHERE role = 'fut') b ON a.ep = b.ep""")
def _(t):
    a = t.grid5.where("role = 'ctd'").select("ep", F.col("l1_ask_price").alias("target"))
    b = t.grid5.where("role = 'fut'").select("ep", F.col("l1_bid_size").alias("feature"))
    return a.join(b, "ep", "full")


@query("join_sampled", "role:s ep:i l1_bid_price:f", """
       SELECT role, ep, l1_bid_price FROM quotes1 WHERE ep IN (SELECT ep FROM quotes1 WHERE event_id % 20 = 3)""")
def _(t):
    picked = t.quotes1.where("event_id % 20 = 3").select("ep")
    return t.quotes1.join(picked, "ep", "left_semi")


@query("join_temporal_market", "ep:i hour_of_day:i ctd_mid:f", """
       SELECT ep, ep % 86400 // 3600 AS hour_of_day, (ctd_bid_price + ctd_ask_price) / 2 AS ctd_mid FROM market5""")
def _(t):
    from tickloom.functions.calendar import calendar

    times = t.market5.select("ep", calendar()["hour_of_day"].alias("hour_of_day"))
    return times.join(t.market5.select("ep", cross.mid("ctd").alias("ctd_mid")), "ep")


@query("interval_join", "ep:i order_id:i", """
       SELECT g.ep, p.order_id FROM (SELECT ep FROM grid5 WHERE role = 'fut') g JOIN proposals p ON g.ep * 1000000 BETWEEN p.start_us AND p.end_us
       WHERE p.status = 0 AND p.check_logon = 0 AND p.bond_code = 'IT0002'""")
def _(t):
    from tickloom.sources.readers import valid_proposals

    orders = valid_proposals(t.proposals, "IT0002").select("order_id", "start_us", "end_us")
    grid = t.grid5.where("role = 'fut'").select("ep", (F.col("ep") * US).alias("us"))
    return B.interval_join(grid, orders, 1800)


def _rolls(t):
    return t.fut_metadata.select(F.col("last_trading").alias("d"))


@query("asof_next_event", "d:d next_event:d days_to_next:i", """
       SELECT x.d, m.last_trading AS next_event, m.last_trading - x.d AS days_to_next FROM (SELECT DISTINCT d FROM lob) x
       ASOF JOIN (SELECT DISTINCT last_trading FROM fut_metadata) m ON x.d <= m.last_trading""")
def _(t):
    return D.event_distance(t.lob, _rolls(t))


@query("asof_prev_event", "d:d prev_event:d days_to_prev:i", """
       SELECT x.d, m.last_trading AS prev_event, m.last_trading - x.d AS days_to_prev FROM (SELECT DISTINCT d FROM lob) x
       ASOF LEFT JOIN (SELECT DISTINCT last_trading FROM fut_metadata) m ON x.d >= m.last_trading""")
def _(t):
    return D.event_distance(t.lob, _rolls(t))


@query("asof_delivery", "d:d isin:s delivery:d", """
       SELECT k.d, k.isin, MIN(m.delivery) AS delivery FROM daily_cf k JOIN fut_metadata m ON m.delivery > k.d GROUP BY k.d, k.isin""")
def _(t):
    return RR.delivery_after(t.daily_cf, t.fut_metadata)


@query("shift_forward", "ep:i horizon:i now:f later:f", """
       SELECT m.ep, h.horizon, m.ctd_bid_price AS now, x.ctd_bid_price AS later FROM market5 m CROSS JOIN (VALUES (600), (86400)) h(horizon)
       LEFT JOIN market5 x ON x.ep = m.ep + h.horizon""")
def _(t):
    out = P.shift_forward(t.market5, (600, 86_400), ["ctd_bid_price"])
    return out.select("ep", "horizon", F.col("ctd_bid_price").alias("now"), F.col("x_ctd_bid_price").alias("later"))


@query("event_between", "ep:i exit_d:d open_hit:b closed_hit:b", """
       SELECT ep, (to_timestamp(ep + 172800)::TIMESTAMP)::DATE AS exit_d,
              EXISTS (SELECT 1 FROM fut_metadata f WHERE f.last_trading > m.d AND f.last_trading < (m.d + 2)) AS open_hit,
              EXISTS (SELECT 1 FROM fut_metadata f WHERE f.last_trading >= m.d AND f.last_trading <= (m.d + 2)) AS closed_hit FROM market5 m""")
def _(t):
    df = t.market5.withColumn("exit_d", day_of(F.col("ep") + 172_800))
    df = D.event_between(df, _rolls(t), "d", "exit_d", entry_inclusive=False, exit_inclusive=False, name="open_hit")
    return D.event_between(df, _rolls(t), "d", "exit_d", entry_inclusive=True, exit_inclusive=True, name="closed_hit")


HIT = """
    SELECT o.event_id, o.side, o.ep, o.lim, (SELECT MIN(q.ep) FROM quotes1 q WHERE q.role = 'ctd' AND q.ep BETWEEN o.ep AND o.ep + 7200
       AND CASE WHEN o.side = 1 THEN q.l1_ask_price <= o.lim ELSE q.l1_bid_price >= o.lim END) AS hit_ep
    FROM (SELECT event_id, ep, d, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side,
                 (l1_bid_price + l1_ask_price) / 2 AS lim FROM quotes1 WHERE role = 'fut') o"""


def _hits(t):
    mid = (F.col("l1_bid_price") + F.col("l1_ask_price")) / 2
    every = stage(t.quotes1)
    orders = every.where("role = 'fut'").select(
        "event_id", "ep", (F.col("ep") + 7200).alias("end_ep"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"), mid.alias("lim"))
    quotes = every.where("role = 'ctd'").select("ep", F.col("l1_bid_price").alias("bid"), F.col("l1_ask_price").alias("ask"))
    return P.first_hit(orders, P.pack_quotes(quotes), ["event_id"], "ep", "end_ep", "lim", "side", "hit_ep"), quotes


@query("first_hit", "event_id:i side:i ep:i lim:f hit_ep:i", HIT)
def _(t):
    return _hits(t)[0]


@query("lookup_at_ts", "event_id:i hit_ep:i bid:f ask:f", f"""
       SELECT h.event_id, h.hit_ep, q.l1_bid_price AS bid, q.l1_ask_price AS ask FROM ({HIT}) h JOIN quotes1 q ON q.role = 'ctd' AND q.ep = h.hit_ep""")
def _(t):
    hits, quotes = _hits(t)
    return hits.drop("ep").join(quotes.withColumnRenamed("ep", "hit_ep"), "hit_ep")


@query("opening_lookup", "episode:i opening_us:i us:i", """
       SELECT episode, MIN(us) AS opening_us, MAX(us) FILTER (terminal) AS us FROM exec_records GROUP BY episode HAVING COUNT(*) FILTER (terminal) > 0""")
def _(t):
    return R.exec_terminal(t.exec_records, ["episode"])


@query("semi_anti_dates", "part:s role:s us:i", f"""
       SELECT 'kept' AS part, role, us FROM lob WHERE d IN ({EXCL}) UNION ALL SELECT 'dropped', role, us FROM lob WHERE d NOT IN ({EXCL})""")
def _(t):
    days = D.excluded_dates(t.excluded_raw)
    a = D.keep_dates(t.lob, days).select(F.lit("kept").alias("part"), "role", "us")
    return a.unionByName(D.drop_dates(t.lob, days).select(F.lit("dropped").alias("part"), "role", "us"))


@query("compare_runs", "metric:s run_a:f run_b:f difference:f same:b", """
       WITH a AS (SELECT 'net' || episode AS metric, SUM(reward) AS v FROM records WHERE seed = 0 AND episode <> 19725 GROUP BY episode),
            b AS (SELECT 'net' || episode AS metric, SUM(reward) AS v FROM records WHERE seed = 1 AND episode <> 19726 GROUP BY episode)
       SELECT COALESCE(a.metric, b.metric) AS metric, a.v AS run_a, b.v AS run_b, a.v - b.v AS difference, a.v IS NOT DISTINCT FROM b.v AS same
       FROM a FULL JOIN b ON a.metric = b.metric WHERE COALESCE(a.metric, b.metric) NOT IN ('net1', 'net2')""")
def _(t):
    def run(seed, gone):
        part = t.records.where((F.col("seed") == seed) & (F.col("episode") != gone))
        return part.groupBy(F.concat(F.lit("net"), "episode").alias("metric")).agg(F.sum("reward").alias("v"))

    return R.compare_runs(run(0, 19725), run(1, 19726), "metric", "v", excluded=("net1", "net2"))
