"""SQL forms of the derived input tables, added to a query only where it names them."""

from __future__ import annotations

import re

from tickloom.schema import book_columns
from tickloom.sources.derived import CLEAN, DAILY_CF, EXEC_RECORDS, FLAWED, LOB, PREDICTIONS, PROPOSALS
from tickloom.sources.static import BOND_COLUMNS, CTD_BONDS, EXCLUDED, EXCLUDED_COLUMNS, FUTURE_COLUMNS, FUTURES, values_sql


def _last(source: str, key: str, step: int) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, us // {step * 1000000} * {step} AS ep, ROW_NUMBER() OVER (PARTITION BY {key}, "
            f"us // {step * 1000000} ORDER BY us DESC, event_id DESC) AS rn FROM {source}) z WHERE rn = 1")


TABLES: dict[str, str] = {
    "lob": "SELECT *, epoch_us(ts) AS us FROM (" + LOB.format(events="events") + ") z",
    "lob_clean": f"SELECT * FROM lob WHERE {CLEAN}",
    "flawed": "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {FLAWED} THEN NULL ELSE {c} END AS {c}" for c in book_columns(1)) + ") FROM lob",
    "flawed1": _last("flawed", "role", 1),
    "book1": _last("lob", "role", 1),
    "quotes1": _last("lob_clean", "role", 1),
    "grid5": _last("lob_clean", "role", 300),
    "book5": _last("lob_clean", "role", 300),
    "coupons": """
        SELECT isin, 100e0 * coupon_rate / coupon_freq AS amount, unnest(generate_series(first_coupon::TIMESTAMP, maturity::TIMESTAMP,
               to_months((12 // coupon_freq)::INT)))::DATE AS c FROM ctd_metadata""",
    "terms": """
        SELECT d, isin, cf, delivery, (delivery - d) / 360e0 AS years,
               COALESCE((SELECT SUM(amount) FROM coupons s WHERE s.isin = k.isin AND s.c > k.d AND s.c <= k.delivery), 0) AS coupons,
               COALESCE((SELECT SUM(amount * (k.delivery - s.c) / 360e0) FROM coupons s WHERE s.isin = k.isin AND s.c > k.d AND s.c <= k.delivery), 0) AS weighted_coupons,
               (SELECT MAX(amount) * (k.d - MAX(c) FILTER (c <= k.d)) / (MIN(c) FILTER (c > k.d) - MAX(c) FILTER (c <= k.d)) FROM coupons s WHERE s.isin = k.isin) AS ai_now,
               (SELECT MAX(amount) * (k.delivery - MAX(c) FILTER (c <= k.delivery)) / (MIN(c) FILTER (c > k.delivery) - MAX(c) FILTER (c <= k.delivery))
                FROM coupons s WHERE s.isin = k.isin) AS ai_delivery
        FROM (SELECT k.d, k.isin, k.cf, MIN(m.delivery) AS delivery FROM daily_cf k JOIN fut_metadata m ON m.delivery > k.d GROUP BY ALL) k""",
    "daily_cf": DAILY_CF.format(events="events"),
    "ctd_metadata": values_sql(CTD_BONDS, BOND_COLUMNS),
    "fut_metadata": values_sql(FUTURES, FUTURE_COLUMNS),
    "excluded_raw": values_sql(EXCLUDED, EXCLUDED_COLUMNS),
    "market5": """
        SELECT c.d, c.ep, c.l1_bid_price AS ctd_bid_price, c.l1_ask_price AS ctd_ask_price, c.l1_bid_size AS ctd_bid_size,
               c.l1_ask_size AS ctd_ask_size, f.l1_bid_price AS fut_bid_price, f.l1_ask_price AS fut_ask_price,
               f.l1_bid_size AS fut_bid_size, f.l1_ask_size AS fut_ask_size, k.cf, k.isin
        FROM grid5 c JOIN grid5 f ON c.ep = f.ep AND f.role = 'fut' LEFT JOIN daily_cf k ON k.d = c.d
        WHERE c.role = 'ctd'""",
    # Second by second: each role's last quote of the day so far.
    "market1": """
        SELECT s.d, s.ep, c.ep AS cep, f.ep AS fep, c.l1_bid_price AS ctd_bid_price, c.l1_ask_price AS ctd_ask_price, c.l1_bid_size AS ctd_bid_size,
               c.l1_ask_size AS ctd_ask_size, f.l1_bid_price AS fut_bid_price, f.l1_ask_price AS fut_ask_price, f.l1_bid_size AS fut_bid_size, f.l1_ask_size AS fut_ask_size, k.cf, k.isin
        FROM (SELECT d, epoch_us(d::TIMESTAMP) // 1000000 + unnest(generate_series(32400, 61200)) AS ep FROM (SELECT DISTINCT d FROM lob_clean) z) s
        ASOF JOIN (SELECT * FROM quotes1 WHERE role = 'ctd') c ON c.d = s.d AND c.ep <= s.ep ASOF JOIN (SELECT * FROM quotes1 WHERE role = 'fut') f ON f.d = s.d AND f.ep <= s.ep
        LEFT JOIN daily_cf k ON k.d = s.d""",
    "basis5": """
        SELECT d, ep, (ctd_ask_price + ctd_bid_price) / 2 - cf * ((fut_ask_price + fut_bid_price) / 2) AS basis FROM market5""",
    "proposals": "SELECT *, epoch_us(update_ts) AS start_us, epoch_us(update_ts) + life_s * 1000000 AS end_us FROM ("
                 + PROPOSALS.format(events="events") + ") z",
    "exec_records": "SELECT * EXCLUDE (ts), epoch_us(ts) AS us FROM (" + EXEC_RECORDS.format(events="events") + ") z",
    "predictions": PREDICTIONS.format(events="events"),
    "records": """
        SELECT seed, episode, ep, d, terminal, allocation, position, CAST(ABS(position - allocation) AS DOUBLE) * 12.5 AS cost,
               gross AS gross_reward, gross - CAST(ABS(position - allocation) AS DOUBLE) * 12.5 AS reward,
               CAST(1 + h % 3 AS DOUBLE) * 200.0 AS ctd_spread, 1e0 AS ctd_contracts,
               CAST(1 + h % 2 AS DOUBLE) * 10.0 AS fut_spread, 18e0 AS fut_contracts,
               100e0 + CAST(h % 17 AS DOUBLE) / 100.0 AS ctd_mid, 110e0 + CAST(h % 13 AS DOUBLE) / 100.0 AS fut_mid
        FROM (SELECT *, COALESCE(LAG(position) OVER (PARTITION BY seed, episode ORDER BY ep), 0) AS allocation,
                     CASE WHEN rn = 1 THEN 0e0 ELSE CAST(h % 201 - 100 AS DOUBLE) END AS gross
              FROM (SELECT *, CASE WHEN rn = 1 OR rr = 1 THEN 0 ELSE h % 3 - 1 END AS position, rr = 1 AS terminal
                    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY seed, episode ORDER BY ep) AS rn,
                                 ROW_NUMBER() OVER (PARTITION BY seed, episode ORDER BY ep DESC) AS rr
                          FROM (SELECT user_id % 3 AS seed, epoch_us(ts) // 86400000000 AS episode, CAST(ts AS DATE) AS d,
                                       epoch_us(ts) // 1000000 AS ep, (event_id * 7919 + user_id * 104729) % 1000003 AS h,
                                       ROW_NUMBER() OVER (PARTITION BY user_id % 3, epoch_us(ts) // 1000000
                                                          ORDER BY ts DESC, event_id DESC) AS k FROM events) a
                          WHERE k = 1) b) c) e""",
}


# Base features on the five-minute grid.
_FLOW = {
    "bid": "CASE WHEN {p} > {q} THEN {s} WHEN {p} = {q} THEN {s} - {z} WHEN {p} < {q} THEN -{z} END",
    "ask": "CASE WHEN {p} > {q} THEN -{z} WHEN {p} = {q} THEN {s} - {z} WHEN {p} < {q} THEN {s} END",
}


def flow_sql(side: str, level: int) -> str:
    """Order flow of one side; needs the windows ``w`` of the previous row."""
    p, s = f"l{level}_{side}_price", f"l{level}_{side}_size"
    return _FLOW[side].format(p=p, s=s, q=f"LAG({p}) OVER w", z=f"LAG({s}) OVER w")


TABLES["role5"] = f"""
    SELECT role, d, ep, (l1_bid_price + l1_ask_price) / 2 AS mid, l1_ask_price - l1_bid_price AS spread, l1_bid_size - l1_ask_size AS obi_1,
           {flow_sql('bid', 1)} AS bof_1, {flow_sql('ask', 1)} AS aof_1 FROM book5 WINDOW w AS (PARTITION BY role, d ORDER BY ep)"""
TABLES["wide5"] = """
    SELECT c.d, c.ep, c.mid - t.cf * f.mid AS basis,
           (f.mid * t.cf + t.ai_delivery - (c.mid + t.ai_now - t.coupons)) / ((c.mid + t.ai_now) * t.years - t.weighted_coupons) AS irr,
           c.mid AS ctd_mid_price, f.mid AS fut_mid_price, c.spread AS ctd_spread, f.spread AS fut_spread, c.obi_1 AS ctd_obi_1, f.obi_1 AS fut_obi_1,
           c.bof_1 AS ctd_bof_1, f.bof_1 AS fut_bof_1, c.aof_1 AS ctd_aof_1, f.aof_1 AS fut_aof_1, c.bof_1 + c.aof_1 AS ctd_ofi_1, t.cf
    FROM role5 c JOIN role5 f ON f.ep = c.ep AND f.role = 'fut' JOIN terms t ON t.d = c.d WHERE c.role = 'ctd'"""


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the derived tables it uses, dependencies first."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in used) + " " + sql
