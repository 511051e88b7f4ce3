"""Classes of updates and their volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import updates as U
from . import query
from .relational import _E, events

#: Raw updates made of the events, by expressions that both engines read.
_UPDATE = {
    "id": "event_id", "us": "us", "kind": "CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'slot' WHEN 1 THEN 'status' ELSE 'account' END WHEN event_type = 'click' THEN 'account' ELSE 'transaction' END",
    "signature": "CASE WHEN event_id % 6 = 0 THEN concat('s', user_id, '.', k % 5) ELSE concat('u', event_id) END", "body": "event_id % 29 <> 0", "create": "event_type = 'purchase' AND k % 25 = 0", "trade": "event_type IN ('purchase', 'error') AND k % 25 <> 0 AND k % 3 <> 1", "broken": "event_type = 'error' AND k % 10 = 7",
    "inner_create": "event_type = 'view' AND k % 31 = 0", "pump": "event_type <> 'view' OR k % 4 = 0", "mint": "CASE WHEN k % 9 = 5 THEN NULL ELSE user_id END", "owner": "CASE WHEN k % 4 < 2 THEN 'token' WHEN k % 4 = 2 THEN 'system' ELSE 'other' END", "empty": "k % 17 = 5", "value": "value",
}


def raw_updates(spark, sf_dir):
    """The events as raw updates, and what is tracked, mapped and pinned in the course of time: large purchases make a mint active, large errors end it."""
    e = events(spark, sf_dir)
    u = e.selectExpr(*[f"{v} as `{n}`" for n, v in _UPDATE.items()], "array(k, k + 100) as accounts", "if(event_id % 3 = 0, array(user_id), cast(array() as array<bigint>)) as balance_mints", "user_id")
    marks = e.where("event_type = 'purchase' and value > 60 or event_type = 'error' and value > 80").selectExpr("user_id as mint", "us", "if(event_type = 'purchase', 'active', 'tombstoned') as status")
    mapping = e.where("event_type = 'click'").selectExpr("k as account", "us", "user_id as mint")
    roles = e.where("event_type = 'view' and k % 8 = 1 or event_type = 'signup' or event_type = 'purchase' and k % 6 = 2").selectExpr("if(event_type = 'view', k + 100, k) as account", "us", "case event_type when 'view' then 'pin' when 'signup' then 'creator' else 'curve' end as role")
    return u, marks, mapping, roles


_BY = lambda s, *via: f"bool_or(status = '{s}' AND via IN ({', '.join(repr(v) for v in via)}))"
_CLASSES = f"""{_E}, u AS (SELECT {', '.join(f'{v} AS "{n}"' for n, v in _UPDATE.items())}, [k, k + 100] AS accounts, CASE WHEN event_id % 3 = 0 THEN [user_id] ELSE [] END AS balance_mints, user_id FROM e),
    mk AS (SELECT user_id AS mint, us, CASE event_type WHEN 'purchase' THEN 'active' ELSE 'tombstoned' END AS status FROM e WHERE event_type = 'purchase' AND value > 60 OR event_type = 'error' AND value > 80),
    mp AS (SELECT k AS account, us, user_id AS m FROM e WHERE event_type = 'click'), ro AS (SELECT CASE event_type WHEN 'view' THEN k + 100 ELSE k END AS account, us, CASE event_type WHEN 'view' THEN 'pin' WHEN 'signup' THEN 'creator' ELSE 'curve' END AS role FROM e WHERE event_type = 'view' AND k % 8 = 1 OR event_type = 'signup' OR event_type = 'purchase' AND k % 6 = 2),
    o AS (SELECT id, us, unnest(accounts) AS account FROM u), kn AS (SELECT o.id, o.us, mp.m, ro.role FROM o ASOF LEFT JOIN mp ON mp.account = o.account AND o.us >= mp.us ASOF LEFT JOIN ro ON ro.account = o.account AND o.us >= ro.us),
    mi AS (SELECT id, us, unnest(balance_mints) AS mint, 'balance' AS via FROM u UNION SELECT id, us, m, 'mapped' FROM kn WHERE m IS NOT NULL UNION SELECT id, us, mint, 'hint' FROM u WHERE mint IS NOT NULL),
    st AS (SELECT mi.*, mk.status FROM mi ASOF LEFT JOIN mk ON mk.mint = mi.mint AND mi.us >= mk.us),
    a AS (SELECT id, {_BY('active', 'balance')} AS act, {_BY('active', 'mapped')} AS acc, {_BY('tombstoned', 'balance', 'mapped')} AS dead, bool_or(via <> 'hint') AS hinted, {_BY('active', 'hint')} AS hact, {_BY('tombstoned', 'hint')} AS hdead FROM st GROUP BY 1),
    b AS (SELECT id, bool_or(role = 'pin') AS pin, bool_or(role = 'curve') AS curve, bool_or(role = 'creator') AS creator FROM kn GROUP BY 1),
    x AS (SELECT u.*, a.* EXCLUDE id, b.* EXCLUDE id, row_number() OVER (PARTITION BY signature ORDER BY us, u.id) > 1 AS again FROM u LEFT JOIN a ON a.id = u.id LEFT JOIN b ON b.id = u.id),
    y AS (SELECT id, user_id, value, CASE kind WHEN 'slot' THEN 'slot_or_liveness_reader_side' WHEN 'status' THEN 'other_untracked'
            WHEN 'account' THEN CASE WHEN "empty" THEN 'other_untracked' WHEN owner = 'token' THEN CASE WHEN acc THEN 'token_account_update_active_mint' ELSE 'token_account_update_untracked' END WHEN curve THEN 'bonding_curve_vault_change' WHEN owner = 'system' AND creator THEN 'creator_funding_hint' ELSE 'holder_owner_change' END
            ELSE CASE WHEN again THEN 'transaction_duplicate_signature' WHEN NOT body THEN 'malformed_or_unknown' WHEN "create" THEN 'pump_token_created'
                WHEN trade THEN CASE WHEN mint IS NULL THEN 'pump_trade_unknown_mint' WHEN hdead THEN 'pump_trade_tombstoned_mint' WHEN hact THEN 'pump_trade_active_mint' ELSE 'pump_trade_untracked_mint' END
                WHEN broken THEN 'malformed_or_unknown' WHEN inner_create THEN 'transaction_token_created' WHEN act THEN 'transaction_active_mint' WHEN acc THEN 'transaction_active_account' WHEN dead THEN 'transaction_tombstoned_mint' WHEN pin THEN 'transaction_account_pinned_unknown'
                WHEN pump THEN 'transaction_untracked_pump' WHEN hinted THEN 'transaction_mapping_hint_only' ELSE 'other_untracked' END END AS class FROM x)"""


@query(f"""WITH {_CLASSES} SELECT id, class, CASE WHEN class LIKE '%token_created' THEN 'critical_launch' WHEN class IN ('transaction_mapping_hint_only', 'creator_funding_hint') THEN 'mapping' WHEN class = 'bonding_curve_vault_change' THEN 'vault_delta' WHEN class IN ('pump_trade_active_mint', 'transaction_active_mint') THEN 'trade_delta'
        WHEN class IN ('transaction_active_account', 'token_account_update_active_mint', 'holder_owner_change') THEN 'holder_delta' ELSE 'cheap_counter' END AS lane,
    CASE WHEN class LIKE '%token_created' THEN 'critical' WHEN class IN ('transaction_mapping_hint_only', 'creator_funding_hint') THEN 'mapping_only' WHEN class IN ('pump_trade_unknown_mint', 'malformed_or_unknown') THEN 'unknown' WHEN class LIKE '%active%' OR class IN ('bonding_curve_vault_change', 'holder_owner_change') THEN 'active_tracked' ELSE 'cheap_skip' END AS relevance,
    class LIKE '%token_created' OR class LIKE '%active%' OR class IN ('bonding_curve_vault_change', 'holder_owner_change') AS deep FROM y""")
def b13_update_classes(spark, sf_dir):
    return U.classified(*raw_updates(spark, sf_dir))


def _with_classes(spark, sf_dir):
    u, *sets = raw_updates(spark, sf_dir)
    return u.select("id", "user_id", "value", "us").join(U.classified(u, *sets).select("id", "class"), "id")


@query(f"""WITH {_CLASSES}, n AS (SELECT class, user_id, count(*) AS n FROM y GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, user_id) AS r FROM n),
    v AS (SELECT class, value, row_number() OVER (PARTITION BY class ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY class) AS t FROM y)
    SELECT class, updates, keys, p50, p90, p95, p99, top_keys FROM (SELECT class, sum(n) AS updates, count(*) AS keys, string_agg(user_id || ':' || n, '|' ORDER BY r) FILTER (r <= 10) AS top_keys FROM r GROUP BY 1)
    JOIN (SELECT class, {', '.join(f'min(value) FILTER (i = (t - 1) * {p} // 100) AS p{p}' for p in U.PERCENTILES)} FROM v GROUP BY 1) USING (class)""")
def b14_class_volume(spark, sf_dir):
    return U.volume(_with_classes(spark, sf_dir), "user_id", "value")


@query()
def b14_sketched_volume(spark, sf_dir):
    """The same from sketches by class and day, merged over the days."""
    parts = U.sketches(_with_classes(spark, sf_dir).withColumn("day", F.expr("us div 86400000000")), ["class", "day"], "user_id", "value")
    return U.from_sketches(parts, ["class"])
