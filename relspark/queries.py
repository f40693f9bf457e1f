"""The query catalogue over the test tables, each with hand-written SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.builder import Not, P, S, V, all_of, allen, any_of, atom, count, duration, eq, ge, gt, lt, max_, min_, ne, pack, point_in, query, rule, sum_
from relspark.functions.allen import BASICS, NAMED, allen_sql
from relspark.operators.constraints import change_violations, violations
from relspark.plans.rewrite import Options
from relspark.sources.tables import HOUR, JUDGED, SCHEMA, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The derived relations in SQL.
BASE = """
region_ AS (SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region),
nation_ AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation),
customer_ AS (SELECT c_custkey AS id, c_nationkey::BIGINT AS nation, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer),
supplier_ AS (SELECT s_suppkey AS id, s_nationkey::BIGINT AS nation, CAST(round(s_acctbal * 100) AS BIGINT) AS balance FROM supplier),
part_ AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS kind, p_size::BIGINT AS size, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part),
order_ AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS total, epoch_us(o_orderdate) AS placed FROM orders),
line_ AS (SELECT DISTINCT l_orderkey AS "order", l_partkey AS part, l_suppkey AS supp, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, epoch_us(l_shipdate) AS ship FROM lineitem),
event_ AS (SELECT event_id AS id, user_id AS "user", (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::BIGINT AS type, CAST(round(value * 100) AS BIGINT) AS value, epoch_us(ts) AS moment FROM events),
span_ AS (SELECT DISTINCT "user", type, moment AS s, moment + 3600000000 AS e FROM event_),
ship_ AS (SELECT DISTINCT l."order", l.line, l.part, o.placed AS s, l.ship AS e FROM line_ l JOIN order_ o ON l."order" = o.id WHERE o.placed < l.ship),
turn_ AS (SELECT DISTINCT conv_id AS conv, turn, role FROM conversations),
next_ AS (SELECT DISTINCT conv_id * 1000 + turn - 1 AS node, conv_id * 1000 + turn AS after FROM conversations WHERE turn > 0),
follow_ AS (SELECT DISTINCT a.part AS src, b.part AS dst, b.qty AS weight FROM line_ a JOIN line_ b ON a."order" = b."order" AND b.line = a.line + 1)
"""


def sql(body: str, recursive: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{', ' + more if more else ''}\n{body}"


def add(name: str, q, names: list[str], oracle: str, options: Options = Options(), recursive: bool = False, more: str = "", **params) -> None:
    QUERIES[name] = lambda spark, sf_dir: load(spark, sf_dir).run(q, names=names, options=options, **params)
    ORACLES[name] = sql(oracle, recursive, more)


def count_long(col: str) -> str:
    return f"CAST({col} AS BIGINT)"


# Selections and projections
add("point_order", query(rule([V.c, V.t], atom("Order", id=7, cust=V.c, total=V.t))), ["cust", "total"], "SELECT DISTINCT cust, total FROM order_ WHERE id = 7")
add("missing_order", query(rule([V.c], atom("Order", id=P.k, cust=V.c))), ["cust"], "SELECT DISTINCT cust FROM order_ WHERE id = -5", k=-5)
add("project_segments", query(rule([V.s], atom("Customer", segment=V.s))), ["segment"], "SELECT DISTINCT segment FROM customer_")
add("range_orders", query(rule([V.o, V.t], atom("Order", id=V.o, total=V.t), ge(V.t, 10_000_000), lt(V.t, 20_000_000))), ["id", "total"], "SELECT DISTINCT id, total FROM order_ WHERE total >= 10000000 AND total < 20000000")
add("orders_param_set", query(rule([V.o, V.t], atom("Order", id=V.o, cust=S.cs, total=V.t))), ["id", "total"], "SELECT DISTINCT id, total FROM order_ WHERE cust IN (1, 5, 9, 1000000)", cs={1, 5, 9, 1000000})
add("empty_param_set", query(rule([V.o], atom("Order", id=V.o, cust=S.cs))), ["id"], "SELECT id FROM order_ WHERE false", cs=set())
add("param_set_compare", query(rule([V.o, V.s], atom("Order", id=V.o, status=V.s), eq(V.s, S.ss))), ["id", "status"], "SELECT DISTINCT id, status FROM order_ WHERE status IN ('F', 'P')", ss={"F", "P"})
add("repeated_var", query(rule([V.o, V.l], atom("Line", order=V.o, line=V.l, qty=V.l))), ["order", "line"], 'SELECT DISTINCT "order", line FROM line_ WHERE line = qty')
add("not_equal", query(rule([V.r], atom("Region", id=V.i, name=V.r), ne(V.i, 2))), ["name"], "SELECT DISTINCT name FROM region_ WHERE id <> 2")
add("or_tree", query(rule([V.o, V.s, V.t], atom("Order", id=V.o, status=V.s, total=V.t), any_of(eq(V.s, "F"), gt(V.t, 30_000_000)))), ["id", "status", "total"], "SELECT DISTINCT id, status, total FROM order_ WHERE status = 'F' OR total > 30000000")
add("and_or_tree", query(rule([V.o], atom("Order", id=V.o, status=V.s, total=V.t, cust=V.c), any_of(all_of(eq(V.s, "O"), lt(V.t, 5_000_000)), all_of(eq(V.s, "F"), any_of(lt(V.c, 40), gt(V.t, 25_000_000)))))), ["id"], "SELECT DISTINCT id FROM order_ WHERE (status = 'O' AND total < 5000000) OR (status = 'F' AND (cust < 40 OR total > 25000000))")
add("dead_range", query(rule([V.o], atom("Order", id=V.o, total=V.t), lt(V.t, 10), gt(V.t, 50))), ["id"], "SELECT id FROM order_ WHERE total < 10 AND total > 50")

# Joins
add("walk_customer_orders", query(rule([V.n, V.c, V.o], atom("Order", id=V.o, cust=V.c), atom("Customer", id=V.c, nation=V.k), atom("Nation", id=V.k, name=V.n))), ["nation", "cust", "order"], 'SELECT DISTINCT n.name AS nation, c.id AS cust, o.id AS "order" FROM order_ o JOIN customer_ c ON o.cust = c.id JOIN nation_ n ON c.nation = n.id')
add("chain4", query(rule([V.r, V.l], atom("Region", id=V.g, name=V.r), atom("Nation", id=V.k, region=V.g), atom("Customer", id=V.c, nation=V.k), atom("Order", id=V.o, cust=V.c, total=V.t), atom("Line", order=V.o, line=V.l, price=V.p), gt(V.t, 20_000_000), gt(V.p, 8_000_000))), ["region", "line"], "SELECT DISTINCT r.name AS region, l.line FROM region_ r JOIN nation_ n ON n.region = r.id JOIN customer_ c ON c.nation = n.id JOIN order_ o ON o.cust = c.id JOIN line_ l ON l.\"order\" = o.id WHERE o.total > 20000000 AND l.price > 8000000")
add("selfjoin_same_part_spread", query(rule([V.p, V.a, V.b], atom("Line", part=V.p, order=V.a, qty=V.q), atom("Line", part=V.p, order=V.b, qty=V.r), lt(V.q, V.r), gt(V.r, 40))), ["part", "a", "b"], 'SELECT DISTINCT a.part, a."order" AS a, b."order" AS b FROM line_ a JOIN line_ b ON a.part = b.part AND a.qty < b.qty WHERE b.qty > 40')
add("triangle_part_supp_order", query(rule([V.p, V.s, V.o], atom("Line", order=V.o, part=V.p), atom("Line", order=V.o, supp=V.s), atom("Line", part=V.p, supp=V.s))), ["part", "supp", "order"], 'SELECT DISTINCT a.part, b.supp, a."order" AS "order" FROM line_ a JOIN line_ b ON a."order" = b."order" JOIN line_ c ON c.part = a.part AND c.supp = b.supp')
add("product_regions", query(rule([V.a, V.b], atom("Region", name=V.a), atom("Region", name=V.b))), ["a", "b"], "SELECT DISTINCT a.name AS a, b.name AS b FROM region_ a, region_ b")
add("semi_customers_with_orders", query(rule([V.c], atom("Customer", id=V.c, segment="BUILDING"), atom("Order", cust=V.c, total=V.t), gt(V.t, 15_000_000))), ["cust"], "SELECT DISTINCT id AS cust FROM customer_ c WHERE segment = 'BUILDING' AND EXISTS (SELECT 1 FROM order_ o WHERE o.cust = c.id AND o.total > 15000000)")
add("gate_nonempty", query(rule([V.r], atom("Region", name=V.r), atom("Order", status="F"))), ["name"], "SELECT DISTINCT name FROM region_ WHERE EXISTS (SELECT 1 FROM order_ WHERE status = 'F')")
add("gate_empty_negated", query(rule([V.r], atom("Region", name=V.r), Not(atom("Order", status="X")))), ["name"], "SELECT DISTINCT name FROM region_ WHERE NOT EXISTS (SELECT 1 FROM order_ WHERE status = 'X')")
add("gate_closed", query(rule([V.r], atom("Region", name=V.r), atom("Order", status="X"))), ["name"], "SELECT name FROM region_ WHERE false")
add("customers_without_orders", query(rule([V.c], atom("Customer", id=V.c), Not(atom("Order", cust=V.c)))), ["cust"], "SELECT DISTINCT id AS cust FROM customer_ c WHERE NOT EXISTS (SELECT 1 FROM order_ o WHERE o.cust = c.id)")
add("without_big_orders", query(rule([V.c], atom("Customer", id=V.c), Not(atom("Big", V.c))), interiors={"Big": rule([V.c], atom("Order", cust=V.c, total=V.t), gt(V.t, 30_000_000))}), ["cust"], "SELECT DISTINCT id AS cust FROM customer_ c WHERE NOT EXISTS (SELECT 1 FROM order_ o WHERE o.cust = c.id AND o.total > 30000000)")

# Unions
add("union_event_types", query(*(rule([V.u], atom("Event", user=V.u, type=k, value=V.v), gt(V.v, m)) for k, m in ((0, 9_000), (2, 5_000), (3, 1_000)))), ["user"], 'SELECT DISTINCT "user" FROM event_ WHERE (type = 0 AND value > 9000) OR (type = 2 AND value > 5000) OR (type = 3 AND value > 1000)')
add("union_overlap", query(rule([V.o], atom("Order", id=V.o, status="F")), rule([V.o], atom("Order", id=V.o, total=V.t), gt(V.t, 20_000_000))), ["id"], "SELECT id FROM order_ WHERE status = 'F' UNION SELECT id FROM order_ WHERE total > 20000000")
add("union_dead_first", query(rule([V.c], atom("Customer", id=V.c), lt(V.c, 1), gt(V.c, 5)), rule([V.c], atom("Order", id=V.o, cust=V.c))), ["cust"], "SELECT DISTINCT cust FROM order_")
add("union_dead_last", query(rule([V.k], atom("Customer", id=V.c, nation=V.k)), rule([V.k], atom("Nation", id=V.k), lt(V.k, 1), gt(V.k, 5))), ["nation"], "SELECT DISTINCT nation FROM customer_")
add("union_subsumed", query(rule([V.c], atom("Order", id=V.o, cust=V.c), atom("Line", order=V.o, qty=50)), rule([V.c], atom("Order", id=V.o, cust=V.c))), ["cust"], "SELECT DISTINCT cust FROM order_")
add("intersect_rule", query(rule([V.k], atom("Customer", nation=V.k, segment="BUILDING"), atom("Supplier", nation=V.k))), ["nation"], "SELECT nation FROM customer_ WHERE segment = 'BUILDING' INTERSECT SELECT nation FROM supplier_")
add("except_rule", query(rule([V.k], atom("Nation", id=V.k), Not(atom("Supplier", nation=V.k)))), ["nation"], "SELECT id AS nation FROM nation_ EXCEPT SELECT nation FROM supplier_")

# Aggregates
add("count_by", query(rule([V.s, count()], atom("Order", id=V.o, status=V.s))), ["status", "n"], "SELECT status, count(*) AS n FROM order_ GROUP BY status")
add("sum_by", query(rule([V.c, sum_(V.t)], atom("Order", id=V.o, cust=V.c, total=V.t))), ["cust", "total"], "SELECT cust, sum(total)::BIGINT AS total FROM order_ GROUP BY cust")
add("sum_fold_domain", query(rule([V.c, sum_(V.t)], atom("Order", cust=V.c, total=V.t, status=V.s))), ["cust", "total"], "SELECT cust, sum(total)::BIGINT AS total FROM (SELECT DISTINCT cust, total, status FROM order_) GROUP BY cust")
add("minmax_by", query(rule([V.s, min_(V.t), max_(V.t), count()], atom("Order", id=V.o, status=V.s, total=V.t))), ["status", "lo", "hi", "n"], "SELECT status, min(total) AS lo, max(total) AS hi, count(*) AS n FROM order_ GROUP BY status")
add("bool_any_all", query(rule([V.u, min_(V.b), max_(V.b)], atom("Event", user=V.u, type=V.k), atom("EventType", id=V.k, valued=V.b))), ["user", "all_valued", "any_valued"], 'SELECT "user", bool_and(type IN (2, 3)) AS all_valued, bool_or(type IN (2, 3)) AS any_valued FROM event_ GROUP BY "user"')
add("global_sum", query(rule([sum_(V.t), count()], atom("Order", id=V.o, total=V.t))), ["total", "n"], "SELECT sum(total)::BIGINT AS total, count(*) AS n FROM order_ HAVING count(*) > 0")
add("global_sum_empty", query(rule([sum_(V.t), count()], atom("Order", id=V.o, total=V.t, status="X"))), ["total", "n"], "SELECT sum(total)::BIGINT AS total, count(*) AS n FROM order_ WHERE status = 'X' HAVING count(*) > 0")
add("sum_two_rules_headfold", query(*(rule([V.c, sum_(V.t)], atom("Order", cust=V.c, total=V.t, status=k)) for k in ("F", "O"))), ["cust", "total"], "SELECT cust, sum(total)::BIGINT AS total FROM (SELECT cust, total FROM order_ WHERE status = 'F' UNION SELECT cust, total FROM order_ WHERE status = 'O') GROUP BY cust")
add("sum_or_transparent", query(rule([V.c, sum_(V.t)], atom("Order", cust=V.c, total=V.t, status=V.s), any_of(eq(V.s, "F"), eq(V.s, "O")))), ["cust", "total"], "SELECT cust, sum(total)::BIGINT AS total FROM (SELECT DISTINCT cust, total, status FROM order_ WHERE status IN ('F', 'O')) GROUP BY cust")
add("distinct_then_count", query(rule([V.c, count()], atom("Pair", V.c, V.p)), interiors={"Pair": rule([V.c, V.p], atom("Order", id=V.o, cust=V.c), atom("Line", order=V.o, part=V.p))}), ["cust", "parts"], 'SELECT o.cust, count(DISTINCT l.part) AS parts FROM order_ o JOIN line_ l ON l."order" = o.id GROUP BY o.cust')
add("latest_order_per_customer", query(rule([V.c, max_(V.a)], atom("Order", cust=V.c, placed=V.a))), ["cust", "placed"], "SELECT cust, max(placed) AS placed FROM order_ GROUP BY cust")
add("revenue_by_nation", query(rule([V.n, sum_(V.p)], atom("Line", order=V.o, part=V.x, supp=V.y, line=V.l, qty=V.q, ship=V.h, price=V.p), atom("Order", id=V.o, cust=V.c), atom("Customer", id=V.c, nation=V.k), atom("Nation", id=V.k, name=V.n))), ["nation", "revenue"], 'SELECT n.name AS nation, sum(l.price)::BIGINT AS revenue FROM line_ l JOIN order_ o ON l."order" = o.id JOIN customer_ c ON o.cust = c.id JOIN nation_ n ON c.nation = n.id GROUP BY n.name')

# Intervals
T0 = 1_704_500_000_000_000
add("point_in_span", query(rule([V.u, V.i], atom("EventSpan", user=V.u, during=V.a, type=2), atom("Event", id=V.i, user=V.u, at=V.a, type=0))), ["user", "event"], 'SELECT DISTINCT s."user", v.id AS event FROM span_ s JOIN event_ v ON v."user" = s."user" AND s.s <= v.moment AND v.moment < s.e WHERE s.type = 2 AND v.type = 0')
add("span_at_param", query(rule([V.u, V.k], atom("EventSpan", user=V.u, type=V.k, during=P.at))), ["user", "type"], f'SELECT DISTINCT "user", type FROM span_ WHERE s <= {T0} AND {T0} < e', at=T0)
add("any_point_set", query(rule([V.u], atom("EventSpan", user=V.u, during=S.ats))), ["user"], f'SELECT DISTINCT "user" FROM span_ WHERE (s <= {T0} AND {T0} < e) OR (s <= {T0 + 10 * HOUR} AND {T0 + 10 * HOUR} < e)', ats={T0, T0 + 10 * HOUR})
add("point_in_condition", query(rule([V.o, V.l], atom("Shipment", order=V.o, line=V.l, during=V.d), point_in(V.d, T0))), ["order", "line"], f'SELECT DISTINCT "order", line FROM ship_ WHERE s <= {T0} AND {T0} < e')
add("constant_interval_point", query(rule([V.i], atom("Event", id=V.i, at=V.a), point_in((T0, T0 + 6 * HOUR), V.a))), ["event"], f"SELECT DISTINCT id AS event FROM event_ WHERE moment >= {T0} AND moment < {T0 + 6 * HOUR}")
for _name in [*BASICS, "intersects", "disjoint", "covers", "covered_by"]:
    _one, _two = (4, 3) if _name in ("before", "after", "disjoint") else (2, 0)
    add(
        f"allen_{_name}",
        query(rule([V.u, V.a, V.b], atom("EventSpan", user=V.u, type=_one, during=V.a), atom("EventSpan", user=V.u, type=_two, during=V.b), allen(_name, V.a, V.b))),
        ["user", "a", "b"],
        f'SELECT DISTINCT x."user", x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM span_ x JOIN span_ y ON x."user" = y."user" WHERE x.type = {_one} AND y.type = {_two} AND {allen_sql(NAMED[_name], "x.s", "x.e", "y.s", "y.e")}',
    )
for _name in ("starts", "during", "finishes", "overlaps", "contains|meets"):
    _mask = 0
    for _x in _name.split("|"):
        _mask |= NAMED[_x]
    add(
        f"ship_{_name.replace('|', '_or_')}",
        query(rule([V.p, V.a, V.b], atom("Shipment", part=V.p, during=V.a), atom("Shipment", part=V.p, during=V.b), allen(_mask, V.a, V.b))),
        ["part", "a", "b"],
        f"SELECT DISTINCT x.part, x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM ship_ x JOIN ship_ y ON x.part = y.part WHERE {allen_sql(_mask, 'x.s', 'x.e', 'y.s', 'y.e')}",
    )
add("allen_literal", query(rule([V.u, V.d], atom("EventSpan", user=V.u, during=V.d), allen("during|starts|finishes", V.d, P.day))), ["user", "during"], f'SELECT DISTINCT "user", s AS during_start, e AS during_end FROM span_ WHERE (s > {T0} AND e < {T0 + 24 * HOUR}) OR (s = {T0} AND e < {T0 + 24 * HOUR}) OR (s > {T0} AND e = {T0 + 24 * HOUR})', day=(T0, T0 + 24 * HOUR))
add("interval_eq", query(rule([V.u, V.w, V.a], atom("EventSpan", user=V.u, type=V.k, during=V.a), atom("EventSpan", user=V.w, type=V.j, during=V.b), eq(V.a, V.b), lt(V.u, V.w))), ["u", "w", "during"], 'SELECT DISTINCT x."user" AS u, y."user" AS w, x.s AS during_start, x.e AS during_end FROM span_ x JOIN span_ y ON x.s = y.s AND x.e = y.e AND x."user" < y."user"')
add("interval_ne", query(rule([V.o, V.a, V.b], atom("Shipment", order=V.o, during=V.a), atom("Shipment", order=V.o, during=V.b), ne(V.a, V.b))), ["order", "a", "b"], 'SELECT DISTINCT x."order", x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM ship_ x JOIN ship_ y ON x."order" = y."order" WHERE (x.s <> y.s OR x.e <> y.e)')
add("duration_filter", query(rule([V.o, V.l], atom("Shipment", order=V.o, line=V.l, during=V.d), gt(duration(V.d), 1_000 * 24 * HOUR))), ["order", "line"], f'SELECT DISTINCT "order", line FROM ship_ WHERE e - s > {1_000 * 24 * HOUR}')
add("sum_duration", query(rule([V.p, sum_(duration(V.d))], atom("Shipment", part=V.p, order=V.o, line=V.l, during=V.d))), ["part", "micros"], "SELECT part, CAST(sum(e - s) AS DECIMAL(20,0)) AS micros FROM ship_ GROUP BY part")
add("group_by_duration", query(rule([duration(V.d), count()], atom("Shipment", order=V.o, line=V.l, part=V.p, during=V.d))), ["micros", "n"], "SELECT CAST(e - s AS DECIMAL(20,0)) AS micros, count(*) AS n FROM ship_ GROUP BY 1")


def _islands(keys: str, source: str, order: str = "s, e") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}min(s) AS during_start, max(e) AS during_end FROM (
  SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER ({by}ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, max(e) OVER ({by}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source}))) GROUP BY {lead}island"""


add("pack_by_user", query(rule([V.u, pack(V.d)], atom("EventSpan", user=V.u, during=V.d))), ["user", "during"], _islands('"user"', 'SELECT DISTINCT "user", s, e FROM span_'))
add("pack_global", query(rule([pack(V.d)], atom("EventSpan", user=V.u, type=2, during=V.d))), ["during"], _islands("", "SELECT DISTINCT s, e FROM span_ WHERE type = 2"))
add("pack_hot_users", query(rule([V.u, pack(V.d)], atom("EventSpan", user=V.u, during=V.d))), ["user", "during"], _islands('"user"', 'SELECT DISTINCT "user", s, e FROM span_'), options=Options(pack_width=24 * HOUR))
add("pack_union", query(*(rule([V.u, pack(V.d)], atom("EventSpan", user=V.u, type=k, during=V.d)) for k in (0, 4))), ["user", "during"], _islands('"user"', 'SELECT DISTINCT "user", s, e FROM span_ WHERE type IN (0, 4)'))
add("busy_without_error", query(rule([V.u, V.d], atom("EventSpan", user=V.u, type=2, during=V.d), atom("Event", user=V.u, type=0, at=V.a), point_in(V.d, V.a), Not(atom("EventSpan", user=V.u, type=1, during=V.a)))), ["user", "during"], 'SELECT DISTINCT x."user", x.s AS during_start, x.e AS during_end FROM span_ x JOIN event_ v ON v."user" = x."user" AND v.type = 0 AND x.s <= v.moment AND v.moment < x.e WHERE x.type = 2 AND NOT EXISTS (SELECT 1 FROM span_ y WHERE y."user" = x."user" AND y.type = 1 AND y.s <= v.moment AND v.moment < y.e)')

# Graph: parts that follow one another in an order
add("graph_neighbors", query(rule([V.b], atom("Follow", src=P.start, dst=V.b))), ["part"], "SELECT DISTINCT dst AS part FROM follow_ WHERE src = 17", start=17)
add("graph_two_hop", query(rule([V.c], atom("Follow", src=P.start, dst=V.b), atom("Follow", src=V.b, dst=V.c))), ["part"], "SELECT DISTINCT y.dst AS part FROM follow_ x JOIN follow_ y ON x.dst = y.src WHERE x.src = 17", start=17)
add("graph_three_hop_count", query(rule([count()], atom("Follow", src=P.start, dst=V.b), atom("Follow", src=V.b, dst=V.c), atom("Follow", src=V.c, dst=V.d))), ["n"], "SELECT count(*) AS n FROM (SELECT DISTINCT x.dst AS b, y.dst AS c, z.dst AS d FROM follow_ x JOIN follow_ y ON x.dst = y.src JOIN follow_ z ON y.dst = z.src WHERE x.src = 17) HAVING count(*) > 0", start=17)
add("graph_mutual", query(rule([V.a, V.b], atom("Follow", src=V.a, dst=V.b), atom("Follow", src=V.b, dst=V.a), lt(V.a, V.b))), ["a", "b"], "SELECT DISTINCT x.src AS a, x.dst AS b FROM follow_ x JOIN follow_ y ON x.dst = y.src AND x.src = y.dst WHERE x.src < x.dst")
add("graph_triangles", query(rule([V.a, V.b, V.c], atom("Follow", src=V.a, dst=V.b), atom("Follow", src=V.b, dst=V.c), atom("Follow", src=V.c, dst=V.a), lt(V.a, V.b), lt(V.a, V.c))), ["a", "b", "c"], "SELECT DISTINCT x.src AS a, y.src AS b, z.src AS c FROM follow_ x JOIN follow_ y ON x.dst = y.src JOIN follow_ z ON y.dst = z.src AND z.dst = x.src WHERE x.src < y.src AND x.src < z.src")
add("graph_weighted_hop", query(rule([V.c, sum_(V.w)], atom("Follow", src=P.start, dst=V.b), atom("Follow", src=V.b, dst=V.c, weight=V.w))), ["part", "weight"], "SELECT c AS part, sum(weight)::BIGINT AS weight FROM (SELECT DISTINCT y.src AS b, y.dst AS c, y.weight FROM follow_ x JOIN follow_ y ON x.dst = y.src WHERE x.src = 17) GROUP BY c", start=17)
add("ring_of_four", query(rule([V.a, V.c], atom("Follow", src=V.a, dst=V.b), atom("Follow", src=V.b, dst=V.c), atom("Follow", src=V.c, dst=V.d), atom("Follow", src=V.d, dst=V.a), lt(V.a, V.b), lt(V.a, V.c), lt(V.a, V.d))), ["a", "c"], "SELECT DISTINCT p.a, p.c FROM hop p JOIN hop q ON p.c = q.a AND q.c = p.a WHERE p.a < p.b AND p.a < p.c AND p.a < q.b", more="hop AS (SELECT DISTINCT x.src AS a, x.dst AS b, y.dst AS c FROM follow_ x JOIN follow_ y ON x.dst = y.src)")
add("ring_reach", query(rule([V.b], atom("Round", V.b)), rec=("Round", [rule([V.b], atom("Follow", src=P.start, dst=V.b))], [rule([V.c], atom("Round", V.b), atom("Follow", src=V.b, dst=V.c))])), ["part"], "SELECT b AS part FROM f", recursive=True, more="f(b) AS (SELECT dst FROM follow_ WHERE src = 17 UNION SELECT follow_.dst FROM f JOIN follow_ ON f.b = follow_.src)", start=17)

# Stars of facts and dimensions
_WHOLE_LINE = {"order": V.o, "part": V.x, "supp": V.y, "line": V.l, "qty": V.q, "ship": V.h, "price": V.p}
add("olap_by_brand", query(rule([V.b, sum_(V.p), count()], atom("Line", **_WHOLE_LINE), atom("Part", id=V.x, brand=V.b))), ["brand", "revenue", "n"], "SELECT brand, sum(l.price)::BIGINT AS revenue, count(*) AS n FROM line_ l JOIN part_ p ON l.part = p.id GROUP BY brand")
add("olap_region_segment", query(rule([V.r, V.s, sum_(V.p)], atom("Line", **_WHOLE_LINE), atom("Order", id=V.o, cust=V.c), atom("Customer", id=V.c, nation=V.k, segment=V.s), atom("Nation", id=V.k, region=V.g), atom("Region", id=V.g, name=V.r))), ["region", "segment", "revenue"], 'SELECT r.name AS region, c.segment, sum(l.price)::BIGINT AS revenue FROM line_ l JOIN order_ o ON l."order" = o.id JOIN customer_ c ON o.cust = c.id JOIN nation_ n ON c.nation = n.id JOIN region_ r ON n.region = r.id GROUP BY ALL')
add("olap_sliced", query(rule([V.s, sum_(V.p)], atom("Line", **_WHOLE_LINE), atom("Order", id=V.o, status=V.s), ge(V.q, 10), lt(V.q, 30))), ["status", "revenue"], 'SELECT status, sum(l.price)::BIGINT AS revenue FROM line_ l JOIN order_ o ON l."order" = o.id WHERE qty >= 10 AND qty < 30 GROUP BY status')
add("olap_extremes", query(rule([V.k, min_(V.p), max_(V.p), count()], atom("Line", **_WHOLE_LINE), atom("Supplier", id=V.y, nation=V.k))), ["nation", "lo", "hi", "n"], "SELECT s.nation, min(l.price) AS lo, max(l.price) AS hi, count(*) AS n FROM line_ l JOIN supplier_ s ON l.supp = s.id GROUP BY s.nation")
add("olap_buyers_of_brand", query(rule([V.b, count()], atom("Buys", V.b, V.c)), interiors={"Buys": rule([V.b, V.c], atom("Line", order=V.o, part=V.x), atom("Order", id=V.o, cust=V.c), atom("Part", id=V.x, brand=V.b))}), ["brand", "buyers"], 'SELECT p.brand, count(DISTINCT o.cust) AS buyers FROM line_ l JOIN order_ o ON l."order" = o.id JOIN part_ p ON l.part = p.id GROUP BY p.brand')
add("olap_total", query(rule([sum_(V.p), count()], atom("Line", **_WHOLE_LINE), atom("Part", id=V.x, size=V.z), gt(V.z, 25))), ["revenue", "n"], "SELECT sum(l.price)::BIGINT AS revenue, count(*) AS n FROM line_ l JOIN part_ p ON l.part = p.id WHERE p.size > 25 HAVING count(*) > 0")

# Joins of many relations
add("join_star", query(rule([V.b, V.k], atom("Line", part=V.x, supp=V.y, qty=50), atom("Part", id=V.x, brand=V.b), atom("Supplier", id=V.y, nation=V.k))), ["brand", "nation"], "SELECT DISTINCT p.brand, s.nation FROM line_ l JOIN part_ p ON l.part = p.id JOIN supplier_ s ON l.supp = s.id WHERE l.qty = 50")
add("join_same_nation", query(rule([V.o, V.k], atom("Order", id=V.o, cust=V.c), atom("Customer", id=V.c, nation=V.k), atom("Line", order=V.o, supp=V.y), atom("Supplier", id=V.y, nation=V.k))), ["order", "nation"], 'SELECT DISTINCT o.id AS "order", c.nation FROM order_ o JOIN customer_ c ON o.cust = c.id JOIN line_ l ON l."order" = o.id JOIN supplier_ s ON l.supp = s.id AND s.nation = c.nation')
add("join_five_way", query(rule([V.r, V.b], atom("Region", id=V.g, name=V.r), atom("Nation", id=V.k, region=V.g), atom("Supplier", id=V.y, nation=V.k), atom("Line", supp=V.y, part=V.x, price=V.p), atom("Part", id=V.x, brand=V.b), gt(V.p, 9_000_000))), ["region", "brand"], "SELECT DISTINCT r.name AS region, p.brand FROM region_ r JOIN nation_ n ON n.region = r.id JOIN supplier_ s ON s.nation = n.id JOIN line_ l ON l.supp = s.id JOIN part_ p ON l.part = p.id WHERE l.price > 9000000")
add("join_two_customers", query(rule([V.a, V.b], atom("Order", id=V.o, cust=V.a), atom("Line", order=V.o, part=V.x, qty=50), atom("Line", order=V.m, part=V.x, qty=49), atom("Order", id=V.m, cust=V.b), lt(V.a, V.b))), ["a", "b"], 'SELECT DISTINCT o.cust AS a, m.cust AS b FROM order_ o JOIN line_ x ON x."order" = o.id AND x.qty = 50 JOIN line_ y ON y.part = x.part AND y.qty = 49 JOIN order_ m ON y."order" = m.id WHERE o.cust < m.cust')
add("join_never_bought", query(rule([V.x], atom("Part", id=V.x), Not(atom("Line", part=V.x, qty=1))), rule([V.x], atom("Part", id=V.x, size=50))), ["part"], "SELECT id AS part FROM part_ p WHERE NOT EXISTS (SELECT 1 FROM line_ l WHERE l.part = p.id AND l.qty = 1) UNION SELECT id FROM part_ WHERE size = 50")
add("join_chain_back", query(rule([V.c, V.k], atom("Customer", id=V.c, nation=V.k), atom("Order", id=V.o, cust=V.c, status="F"), Not(atom("Local", V.o))), interiors={"Local": rule([V.o], atom("Order", id=V.o, cust=V.c), atom("Customer", id=V.c, nation=V.k), atom("Line", order=V.o, supp=V.y), atom("Supplier", id=V.y, nation=V.k))}), ["cust", "nation"], 'SELECT DISTINCT c.id AS cust, c.nation FROM customer_ c JOIN order_ o ON o.cust = c.id AND o.status = \'F\' WHERE NOT EXISTS (SELECT 1 FROM line_ l JOIN supplier_ s ON l.supp = s.id WHERE l."order" = o.id AND s.nation = c.nation)')

# Calendar
add("calendar_conflict_pairs", query(rule([V.u, V.a, V.b], atom("EventSpan", user=V.u, type=V.j, during=V.a), atom("EventSpan", user=V.u, type=V.k, during=V.b), allen("intersects", V.a, V.b), ne(V.j, V.k))), ["user", "a", "b"], 'SELECT DISTINCT x."user", x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM span_ x JOIN span_ y ON x."user" = y."user" AND x.s < y.e AND y.s < x.e AND x.type <> y.type')
add("calendar_conflict_free", query(rule([V.u, V.i], atom("Event", id=V.i, user=V.u, type=3, at=V.a), Not(atom("EventSpan", user=V.u, type=4, during=V.a)), Not(atom("EventSpan", user=V.u, type=0, during=V.a)))), ["user", "event"], 'SELECT DISTINCT v."user", v.id AS event FROM event_ v WHERE v.type = 3 AND NOT EXISTS (SELECT 1 FROM span_ y WHERE y."user" = v."user" AND y.type IN (0, 4) AND y.s <= v.moment AND v.moment < y.e)')
add("calendar_meets_chain", query(rule([V.u, V.a, V.b], atom("EventSpan", user=V.u, during=V.a), atom("EventSpan", user=V.u, during=V.b), allen("meets|met_by", V.a, V.b))), ["user", "a", "b"], 'SELECT DISTINCT x."user", x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM span_ x JOIN span_ y ON x."user" = y."user" AND (x.e = y.s OR y.e = x.s)')
add("calendar_claim_hours", query(rule([V.u, sum_(duration(V.d))], atom("EventSpan", user=V.u, type=V.k, during=V.d))), ["user", "micros"], 'SELECT "user", CAST(sum(e - s) AS DECIMAL(20,0)) AS micros FROM span_ GROUP BY "user"')
add("calendar_slot_booking", query(rule([V.u, V.a, V.b], atom("EventSpan", user=V.u, type=2, during=V.a), atom("Shipment", part=V.u, during=V.b), allen("during", V.a, V.b))), ["user", "a", "b"], 'SELECT DISTINCT x."user", x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM span_ x JOIN ship_ y ON y.part = x."user" WHERE x.type = 2 AND y.s < x.s AND x.e < y.e')
add("keyless_overlap", query(rule([V.a, V.b], atom("EventSpan", type=3, during=V.a), atom("EventSpan", type=1, during=V.b), allen("intersects", V.a, V.b))), ["a", "b"], "SELECT DISTINCT x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM span_ x JOIN span_ y ON x.s < y.e AND y.s < x.e WHERE x.type = 3 AND y.type = 1")
add("keyless_point", query(rule([V.o], atom("Order", id=V.o, placed=V.a), atom("EventSpan", type=1, during=V.a))), ["order"], 'SELECT DISTINCT o.id AS "order" FROM order_ o JOIN span_ x ON x.s <= o.placed AND o.placed < x.e WHERE x.type = 1')
add("keyless_not_covered", query(rule([V.o], atom("Order", id=V.o, placed=V.a), Not(atom("EventSpan", type=1, during=V.a)))), ["order"], 'SELECT DISTINCT id AS "order" FROM order_ o WHERE NOT EXISTS (SELECT 1 FROM span_ x WHERE x.type = 1 AND x.s <= o.placed AND o.placed < x.e)')
add("overlap_hot_users", query(rule([V.u, V.a, V.b], atom("EventSpan", user=V.u, type=4, during=V.a), atom("EventSpan", user=V.u, type=0, during=V.b), allen("intersects", V.a, V.b))), ["user", "a", "b"], 'SELECT DISTINCT x."user", x.s AS a_start, x.e AS a_end, y.s AS b_start, y.e AS b_end FROM span_ x JOIN span_ y ON x."user" = y."user" AND x.s < y.e AND y.s < x.e WHERE x.type = 4 AND y.type = 0', options=Options(bucket_spans="all"))

# Closed vocabularies
add("closed_vocab_filter", query(rule([V.u, count()], atom("Event", id=V.i, user=V.u, type=V.k), atom("EventType", id=V.k, valued=True))), ["user", "n"], 'SELECT "user", count(*) AS n FROM event_ WHERE type IN (2, 3) GROUP BY "user"')
add("closed_vocab_negated", query(rule([V.i], atom("Event", id=V.i, type=V.k), Not(atom("EventType", id=V.k, valued=True)))), ["event"], "SELECT DISTINCT id AS event FROM event_ WHERE type NOT IN (2, 3)")

# Recursion
_REACH = ("Reach", [rule([V.a, V.b], atom("Next", node=V.a, after=V.b))], [rule([V.a, V.c], atom("Reach", V.a, V.b), atom("Next", node=V.b, after=V.c))])
_REACH_SQL = "reach(a, b) AS (SELECT node, after FROM next_ UNION SELECT reach.a, next_.after FROM reach JOIN next_ ON reach.b = next_.node)"
add("reach_turns", query(rule([V.a, V.b], atom("Reach", V.a, V.b)), rec=_REACH), ["a", "b"], "SELECT a, b FROM reach", recursive=True, more=_REACH_SQL)
add("reach_count", query(rule([V.a, count()], atom("Reach", V.a, V.b)), rec=_REACH), ["a", "n"], "SELECT a, count(*) AS n FROM reach GROUP BY a", recursive=True, more=_REACH_SQL)
add("reach_from_param", query(rule([V.b], atom("From", V.b)), rec=("From", [rule([V.b], atom("Next", node=P.start, after=V.b))], [rule([V.c], atom("From", V.b), atom("Next", node=V.b, after=V.c))])), ["b"], "SELECT b FROM f", recursive=True, more="f(b) AS (SELECT after FROM next_ WHERE node = 3000 UNION SELECT next_.after FROM f JOIN next_ ON f.b = next_.node)", start=3000)
add("roots_not_reached", query(rule([V.a], atom("Next", node=V.a), Not(atom("Hit", V.a))), rec=("Hit", [rule([V.b], atom("Next", after=V.b))], [rule([V.c], atom("Hit", V.b), atom("Next", node=V.b, after=V.c))])), ["root"], "SELECT DISTINCT node AS root FROM next_ EXCEPT SELECT after FROM next_")
add("cycle_closure", query(rule([V.a, V.b], atom("Walk", V.a, V.b)), rec=("Walk", [rule([V.a, V.b], atom("Link", V.a, V.b))], [rule([V.a, V.c], atom("Walk", V.a, V.b), atom("Link", V.b, V.c))]), interiors={"Link": [rule([V.a, V.b], atom("Customer", id=V.x, nation=V.a), atom("Order", cust=V.x, id=V.o), atom("Line", order=V.o, supp=V.y, qty=50), atom("Supplier", id=V.y, nation=V.b))]}), ["a", "b"], "SELECT a, b FROM walk", recursive=True, more='link AS (SELECT DISTINCT c.nation AS a, s.nation AS b FROM customer_ c JOIN order_ o ON o.cust = c.id JOIN line_ l ON l."order" = o.id AND l.qty = 50 JOIN supplier_ s ON s.id = l.supp), walk(a, b) AS (SELECT a, b FROM link UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a)')

# Rewrites on and off
_FK = query(rule([V.o, V.c], atom("Order", id=V.o, cust=V.c), atom("Customer", id=V.c)))
for _on in (True, False):
    add(f"fk_elim_{'on' if _on else 'off'}", _FK, ["order", "cust"], 'SELECT DISTINCT o.id AS "order", o.cust FROM order_ o JOIN customer_ c ON o.cust = c.id', options=Options(drop_references=_on))


# Reads of an instance
def add_read(name: str, read, oracle: str) -> None:
    QUERIES[name] = read
    ORACLES[name] = sql(oracle)


add_read("scan_region", lambda spark, d: load(spark, d).scan("Region"), "SELECT id, name FROM region_")
add_read("scan_closed", lambda spark, d: load(spark, d).scan("EventType"), "SELECT * FROM (VALUES (0::BIGINT, false), (1, false), (2, true), (3, true), (4, false)) t(id, valued)")
add_read("keyed_get", lambda spark, d: load(spark, d).get("Customer", id=11), "SELECT id, nation, segment, balance FROM customer_ WHERE id = 11")
add_read("relation_count", lambda spark, d: load(spark, d).scan("Line").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM line_")


# Constraint judgments: the violations themselves
def _judge(picked):
    def run(spark, sf_dir):
        at = load(spark, sf_dir, JUDGED)
        out = violations(at.frames, JUDGED, keys_first=False, loose=at.loose)
        return out.where(F.col("statement") == picked)

    return run


def _fact(r: str, *more: str) -> str:
    """The JSON of a fact in SQL."""
    parts = []
    for c in SCHEMA[r].columns():
        col = {"during_start": "s", "during_end": "e"}.get(c, f'"{c}"')
        parts.append(f"""'"{c}":"' || {col} || '"'""" if c in ("status", "segment") else f"""'"{c}":' || {col}""")
    return "'{' || " + " || ',' || ".join(parts) + " || '}' AS fact"


def _add_judge(name: str, kind: str, r: str, direction: str, rows: str) -> None:
    of = {"Key": lambda s: s.relation, "Contained": lambda s: s.source.relation, "Capacity": lambda s: s.target.relation}[kind]
    picked = next(i for i, s in enumerate(JUDGED.statements) if type(s).__name__ == kind and of(s) == r)
    add_read(name, _judge(picked), f"SELECT {picked}::INTEGER AS statement, '{direction}' AS direction, '{r}' AS relation, {_fact(r)} FROM {rows}")


_add_judge("key_violations", "Key", "Line", "source", 'line_ WHERE ("order", line) IN (SELECT "order", line FROM line_ GROUP BY ALL HAVING count(*) > 1)')
_add_judge("pointwise_violations", "Key", "EventSpan", "source", 'span_ x WHERE EXISTS (SELECT 1 FROM span_ y WHERE y."user" = x."user" AND (y.s, y.e, y.type) <> (x.s, x.e, x.type) AND y.s < x.e AND x.s < y.e)')
_add_judge("containment_violations", "Contained", "Line", "source", "line_ l WHERE qty = 1 AND NOT EXISTS (SELECT 1 FROM part_ p WHERE p.id = l.part)")
_add_judge("capacity_violations", "Capacity", "Order", "target", '(SELECT o.*, (SELECT count(*) FROM line_ l WHERE l."order" = o.id) AS c FROM order_ o) WHERE c < 1 OR c > 6')
_add_judge("capacity_sum_violations", "Capacity", "Customer", "target", "(SELECT c.*, coalesce((SELECT sum(total) FROM order_ o WHERE o.cust = c.id), 0) AS t FROM customer_ c) WHERE t > 2000000000")


def _coverage(spark, sf_dir):
    """Shipments of a part that the packed shipments of the parts next to it in number don't cover."""
    from relspark.operators.constraints import uncovered
    from relspark.schema import Contained, side

    at = load(spark, sf_dir)
    r = at.schema["Shipment"]
    ships = at.scan("Shipment")
    target = ships.where("line <= 3")
    return uncovered(ships.where("line > 3"), r, target, r, Contained(side("Shipment", "part", "during"), side("Shipment", "part", "during")))


add_read("coverage_violations", _coverage, f"""SELECT x."order", x.line, x.part, x.s AS during_start, x.e AS during_end FROM ship_ x
WHERE x.line > 3 AND NOT EXISTS (SELECT 1 FROM ({_islands("part", "SELECT DISTINCT part, s, e FROM ship_ WHERE line <= 3")}) p WHERE p.part = x.part AND p.during_start <= x.s AND x.e <= p.during_end)""")


def _change(spark, sf_dir):
    """Deleting the customers of nation 3 orphans their orders: judged by the change alone."""
    at = load(spark, sf_dir)
    return change_violations(at.facts, {}, {"Customer": at.frames["Customer"].where("nation = 3")}, at.schema)


_ORPHANS = next(i for i, s in enumerate(SCHEMA.statements) if type(s).__name__ == "Contained" and s.source.relation == "Order")
add_read("change_violations", _change, f"SELECT {_ORPHANS}::INTEGER AS statement, 'target' AS direction, 'Order' AS relation, {_fact('Order')} FROM order_ WHERE cust IN (SELECT id FROM customer_ WHERE nation = 3)")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["revenue_by_nation"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "entry"]
