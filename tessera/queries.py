"""Registered graph queries over the star-schema graph, each with the SQL that gives the same rows."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.cli import Shell, complete, hint
from tessera.dataset import TOP_TRADES, star_graph
from tessera.errors import GraphError
from tessera.plans.checkpoint import shared_folder
from tessera.session import GraphSession

#: name -> (query text, parameters, SQL)
CYPHER: dict[str, tuple[str, dict, str | None]] = {}


def _add(name: str, text: str, sql: str | None, **params) -> None:
    CYPHER[name] = (text, params, sql)


TRADES_SQL = f"""trades as (select s, d, w from (
  select s_nationkey::bigint s, c_nationkey::bigint d, round(sum(l_extendedprice * (1 - l_discount)), 2) w,
         row_number() over (partition by s_nationkey order by round(sum(l_extendedprice * (1 - l_discount)), 2) desc, c_nationkey) k
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  where s_nationkey <> c_nationkey group by s_nationkey, c_nationkey) where k <= {TOP_TRADES})"""
PAIRS_SQL = """held as (select distinct l_orderkey o, l_partkey p from lineitem),
copurchased as (select x.p a, y.p b from held x join held y on x.o = y.o and x.p < y.p group by x.p, y.p having count(*) >= 2)"""
TURNS_SQL = """turns as (select conv_id * 100 + turn as id, conv_id, turn from conversations),
nxt as (select x.id f, y.id n from turns x join turns y on y.id = x.id + 1 and y.conv_id = x.conv_id)"""

# sources, filters, predicates
_add("scan_nodes", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.n_regionkey AS r", "select n_nationkey::bigint k, n_name as name, n_regionkey::bigint r from nation")
_add("scan_unlabelled", "MATCH (n) RETURN count(n) AS n", "select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders) + (select count(distinct user_id) from events) + (select count(*) from events) + (select count(*) from conversations) as n")
_add("filter_cmp", "MATCH (o:Orders) WHERE o.o_totalprice >= 200000.0 AND o.o_orderstatus <> 'F' RETURN o.o_orderkey AS k", "select o_orderkey k from orders where o_totalprice >= 200000 and o_orderstatus <> 'F'")
_add("filter_and_or_not", "MATCH (p:Part) WHERE (p.p_size < 5 OR p.p_size > 45) AND NOT p.p_brand = 'Brand#11' RETURN p.p_partkey AS k", "select p_partkey k from part where (p_size < 5 or p_size > 45) and not p_brand = 'Brand#11'")
_add("filter_is_null", "MATCH (n:Nation) OPTIONAL MATCH (n)-[:TRADES]->(m:Nation) WHERE m.n_regionkey = n.n_regionkey WITH n.n_nationkey AS k, m.n_name AS m WHERE m IS NULL RETURN k", f"with {TRADES_SQL} select n_nationkey::bigint k from nation n where not exists (select 1 from trades join nation m on m.n_nationkey = d where s = n.n_nationkey and m.n_regionkey = n.n_regionkey)")
_add("filter_is_not_null", "MATCH (c:Customer) WHERE c.c_acctbal IS NOT NULL RETURN count(*) AS n", "select count(*) n from customer where c_acctbal is not null")
_add("filter_in", "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.c_custkey AS k", "select c_custkey k from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
_add("filter_not_in", "MATCH (c:Customer) WHERE c.c_mktsegment NOT IN ['BUILDING', NULL] RETURN c.c_custkey AS k", "select c_custkey k from customer where c_mktsegment <> 'BUILDING'")
_add("filter_regex", "MATCH (p:Part) WHERE p.p_type =~ '(?i)brass|^PROMO' RETURN p.p_partkey AS k", "select p_partkey k from part where regexp_matches(p_type, '(?i)brass|^PROMO')")
_add("filter_inline_props", "MATCH (n:Nation {n_regionkey: 2}) RETURN n.n_name AS name", "select n_name as name from nation where n_regionkey = 2")
_add("filter_two_wheres", "MATCH (n:Nation) WHERE n.n_regionkey > 1 WHERE n.n_nationkey < 20 RETURN n.n_nationkey AS k", "select n_nationkey::bigint k from nation where n_regionkey > 1 and n_nationkey < 20")
_add("filter_unlike_types", "MATCH (n:Nation) WHERE n.n_name <> 3 RETURN count(*) AS n", "select count(*) n from nation where n_name is not null")
_add("case_searched", "MATCH (p:Part) RETURN CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'medium' ELSE 'large' END AS size, count(*) AS n", "select case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size, count(*) n from part group by 1")
_add("case_simple", "MATCH (o:Orders) RETURN CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s, count(*) AS n", "select case o_orderstatus when 'F' then 1 when 'O' then 2 end::bigint as s, count(*) n from orders group by 1")

# projection
_add("proj_alias", "MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.s_acctbal * 2 AS twice", "select s_suppkey k, s_acctbal * 2 twice from supplier")
_add("proj_star", "MATCH (r:Region) WITH r.r_regionkey AS k, r.r_name AS name RETURN *", "select r_regionkey::bigint k, r_name as name from region")
_add("proj_distinct", "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS seg", "select distinct c_mktsegment seg from customer")
_add("proj_list", "MATCH (n:Nation) RETURN n.n_nationkey AS k, size([n.n_nationkey, n.n_regionkey, NULL]) AS s", "select n_nationkey::bigint k, 3::bigint s from nation")
_add("proj_list_comp", "MATCH (n:Nation) RETURN n.n_nationkey AS k, size([x IN range(1, n.n_nationkey) WHERE x % 3 = n.n_regionkey % 3 | x * 2]) AS s", "select n_nationkey::bigint k, (select count(*) from range(1, n_nationkey::bigint + 1) t(x) where x % 3 = n_regionkey % 3) s from nation where n_nationkey > 0 union all select 0, case when n_regionkey % 3 in (0, 1) then 1 else 0 end from nation where n_nationkey = 0")
_add("proj_cast", "MATCH (p:Part) RETURN p.p_partkey AS k, CAST(p.p_retailprice AS INT64) AS i, CAST(p.p_size AS DOUBLE) AS d, CAST(p.p_size AS STRING) AS s, CAST(p.p_size AS BOOL) AS b", "select p_partkey k, trunc(p_retailprice)::bigint i, p_size::double d, p_size::varchar s, p_size <> 0 as b from part")
_add("param", "MATCH (o:Orders) WHERE o.o_totalprice > $p AND o.o_orderstatus IN $s RETURN count(*) AS n", "select count(*) n from orders where o_totalprice > 150000 and o_orderstatus in ('F', 'P')", p=150000.0, s=["F", "P"])
_add("with_alias", "MATCH (n:Nation) WITH n AS m, n.n_regionkey * 10 AS z WHERE z >= 20 RETURN m.n_name AS name, z", "select n_name as name, n_regionkey::bigint * 10 z from nation where n_regionkey * 10 >= 20")
_add("with_agg_where", "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c.c_custkey AS k, count(*) AS n WHERE n > 12 RETURN k, n", "select o_custkey k, count(*) n from orders group by 1 having count(*) > 12")
_add("return_constant", "RETURN 1 AS one, 'x' AS s", "select 1::bigint one, 'x' s")

# scalar functions
_add("fn_str_case_trim", "MATCH (p:Part) RETURN p.p_partkey AS k, lower(p.p_type) AS l, upper(p.p_name) AS u, trim(concat('  ', p.p_brand, ' ')) AS t, ltrim('  a ') AS lt, rtrim(' a  ') AS rt", "select p_partkey k, lower(p_type) l, upper(p_name) u, p_brand t, 'a ' lt, ' a' rt from part")
_add("fn_str_length", "MATCH (p:Part) RETURN p.p_partkey AS k, length(p.p_name) AS n, length('é') AS b, size(p.p_brand) AS s", "select p_partkey k, strlen(p_name) n, 2::bigint b, strlen(p_brand) s from part")
_add("fn_str_concat", "MATCH (n:Nation) RETURN concat(n.n_name, NULL, '-', n.n_nationkey) AS c, n.n_name + '!' AS p", "select n_name || '-' || n_nationkey c, n_name || '!' p from nation")
_add("fn_str_tests", "MATCH (p:Part) RETURN p.p_partkey AS k, contains(p.p_type, 'A') AS c, starts_with(p.p_brand, 'Brand#1') AS s, ends_with(p.p_brand, '3') AS e", "select p_partkey k, contains(p_type, 'A') c, starts_with(p_brand, 'Brand#1') s, ends_with(p_brand, '3') e from part")
_add("fn_str_parts", "MATCH (p:Part) RETURN p.p_partkey AS k, substring(p.p_name, 2, 3) AS a, substring(p.p_name, 4) AS b, left(p.p_name, 3) AS l, right(p.p_name, 2) AS r, reverse(p.p_brand) AS v", "select p_partkey k, substr(p_name, 3, 3) a, substr(p_name, 5) b, left(p_name, 3) l, right(p_name, 2) r, reverse(p_brand) v from part")
_add("fn_str_pad", "MATCH (n:Nation) RETURN n.n_nationkey AS k, lpad(n.n_name, 12, '*x') AS l, rpad(n.n_name, 6, '.') AS r, repeat('ab', n.n_regionkey) AS p, replace(n.n_name, 'NATION', 'N') AS q", "select n_nationkey::bigint k, lpad(n_name, 12, '*') l, rpad(n_name, 6, '.') r, repeat('ab', n_regionkey) p, replace(n_name, 'NATION', 'N') q from nation")
_add("fn_to_string", "MATCH (n:Nation) RETURN n.n_nationkey AS k, to_string(n.n_nationkey * 1.0) AS d, to_string(NULL) AS z, to_string(n.n_regionkey = 1) AS b, coalesce(NULL, n.n_name) AS c", "select n_nationkey::bigint k, n_nationkey::varchar d, 'NULL' z, case when n_regionkey = 1 then 'true' else 'false' end b, n_name c from nation")
_add("fn_list_access", "UNWIND [1, -1, 0, 5, 3] AS i RETURN i, list_extract([10, 20, 30], i) AS x, list_len([1, 2, NULL]) AS n, list_contains([1, NULL], NULL) AS c", "select i::bigint i, case i when 1 then 10 when -1 then 30 when 3 then 30 end::bigint x, 3::bigint n, true c from (values (1), (-1), (0), (5), (3)) t(i)")
_add("fn_list_build", "RETURN to_string(list_append([1, 2], 3)) AS a, to_string(list_prepend(0, [1])) AS p, to_string(list_concat([1, 2], [2, 3])) AS c, to_string(list_reverse([1, 2, 3])) AS r, to_string(list_sort([3, NULL, 1])) AS s, to_string(list_distinct([1, 2, 1])) AS d", "select '[1, 2, 3]' a, '[0, 1]' p, '[1, 2, 2, 3]' c, '[3, 2, 1]' r, '[NULL, 1, 3]' s, '[1, 2]' d")
_add("fn_list_range", "UNWIND [1, 5, 9] AS a RETURN a, to_string(range(a, 5)) AS r, to_string(range(a, 9, 4)) AS s, size(range(5, a, -1)) AS n", "select a::bigint a, case a when 1 then '[1, 2, 3, 4, 5]' when 5 then '[5]' else '[9, 8, 7, 6, 5]' end r, case a when 1 then '[1, 5, 9]' when 5 then '[5, 9]' else '[9]' end s, case a when 1 then 5 when 5 then 1 else 0 end::bigint n from (values (1), (5), (9)) t(a)")
_add("fn_math_round", "MATCH (c:Customer) RETURN c.c_custkey AS k, ceil(c.c_acctbal) AS c, floor(c.c_acctbal) AS f, round(c.c_acctbal) AS r, abs(c.c_acctbal) AS a, sign(c.c_acctbal) AS s", "select c_custkey k, ceil(c_acctbal)::double c, floor(c_acctbal)::double f, round(c_acctbal)::double r, abs(c_acctbal) a, sign(c_acctbal)::bigint s from customer")
_add("fn_math_log", "MATCH (p:Part) RETURN p.p_partkey AS k, round(sqrt(p.p_size) * 1000000) AS q, round(log(p.p_size) * 1000000) AS l, round(log10(p.p_size) * 1000000) AS t, round(pi() * 1000) AS pi, round(e() * 1000) AS e", "select p_partkey k, round(sqrt(p_size) * 1000000) q, round(ln(p_size) * 1000000) l, round(log10(p_size) * 1000000) t, 3142.0::double pi, 2718.0::double e from part")
_add("fn_convert", "MATCH (p:Part) RETURN p.p_partkey AS k, toInteger(p.p_retailprice) AS i, toFloat(p.p_size) AS f, toInteger('42') AS s", "select p_partkey k, trunc(p_retailprice)::bigint i, p_size::double f, 42::bigint s from part")
_add("fn_dates", "MATCH (o:Orders) WHERE o.o_orderdate >= datetime('1996-01-01T00:00:00') RETURN o.o_orderkey AS k, timestamp(o.o_orderdate) AS t, date('2024-02-29') AS d", "select o_orderkey k, epoch(o_orderdate)::bigint t, date '2024-02-29' d from orders where o_orderdate >= timestamp '1996-01-01'")
_add("arith", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size + 1 AS a, p.p_size - 1.5 AS b, p.p_size * 2 AS c, (p.p_size - 30) / 4 AS d, (p.p_size - 30) % 4 AS m, -p.p_size AS n, p.p_size / 2.0 AS h", "select p_partkey k, p_size::bigint + 1 a, p_size - 1.5::double b, p_size::bigint * 2 c, ((p_size - 30) // 4 + case when (p_size - 30) % 4 <> 0 and false then 1 else 0 end)::bigint d, ((p_size - 30) % 4)::bigint m, -p_size::bigint n, p_size / 2.0::double h from part")

_add("fn_rand_now", "RETURN rand() >= 0.0 AND rand() < 1.0 AS r, date() IS NOT NULL AS d, datetime() IS NOT NULL AS t, timestamp() > 1000000000 AS s", "select true r, true d, true t, true s")
_add("equality_across_types", "UNWIND [1.0, 1.5] AS x RETURN x, x = 1 AS e, x < 2 AS l, [1, 2] = [1, 2] AS a, 'a' = 1 AS n", "select x, x = 1 e, true l, true a, false n from (values (1.0::double), (1.5::double)) t(x)")

# aggregation
_add("agg_count", "MATCH (e:Event) RETURN e.event_type AS t, count(*) AS n, count(e.value) AS v, count(DISTINCT e.value) AS d", "select event_type t, count(*) n, count(value) v, count(distinct value) d from events group by 1")
_add("agg_sum_avg", "MATCH (p:Part) RETURN p.p_brand AS b, sum(p.p_size) AS s, round(avg(p.p_size) * 1000000) AS a, min(p.p_size) AS lo, max(p.p_name) AS hi", "select p_brand b, sum(p_size)::bigint s, round(avg(p_size) * 1000000) a, min(p_size)::bigint lo, max(p_name) hi from part group by 1")
_add("agg_empty", "MATCH (p:Part) WHERE p.p_size < 0 RETURN count(*) AS n, sum(p.p_size) AS s, size(collect(p.p_size)) AS c", "select 0::bigint n, null::bigint s, 0::bigint c")
_add("agg_collect", "MATCH (n:Nation) RETURN n.n_regionkey AS r, to_string(list_sort(collect(n.n_name))) AS l", "select n_regionkey::bigint r, '[' || string_agg(n_name, ', ' order by n_name) || ']' l from nation group by 1")
_add("agg_distinct", "MATCH (o:Orders) RETURN o.o_orderstatus AS s, sum(DISTINCT o.o_custkey) AS d, size(collect(DISTINCT o.o_orderpriority)) AS c", "select o_orderstatus s, sum(distinct o_custkey)::bigint d, count(distinct o_orderpriority) c from orders group by 1")
_add("agg_nested", "MATCH (n:Nation) RETURN n.n_regionkey AS r, count(n) * 10 + min(n.n_nationkey) AS x", "select n_regionkey::bigint r, count(*) * 10 + min(n_nationkey) x from nation group by 1")
_add("agg_having", "MATCH (p:Part) WITH p.p_brand AS b, count(*) AS n WHERE n > 75 RETURN b, n", "select p_brand b, count(*) n from part group by 1 having count(*) > 75")

# order, limits, sets
_add("sort_top", "MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS t ORDER BY o.o_totalprice DESC, k LIMIT 20", "select o_orderkey k, o_totalprice t from orders order by t desc, k limit 20")
_add("sort_nonprojected", "MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_acctbal, c.c_custkey LIMIT 15", "select c_custkey k from customer order by c_acctbal, c_custkey limit 15")
_add("sort_aggregate", "MATCH (p:Part) RETURN p.p_brand AS b, count(*) AS n ORDER BY count(*) DESC, b LIMIT 7", "select p_brand b, count(*) n from part group by 1 order by n desc, b limit 7")
_add("limit_skip", "MATCH (p:Part) RETURN p.p_partkey AS k ORDER BY k SKIP 10 LIMIT 5", "select p_partkey k from part order by k limit 5 offset 10")
_add("union_all", "MATCH (n:Nation) RETURN n.n_regionkey AS k UNION ALL MATCH (r:Region) RETURN r.r_regionkey AS x", "select n_regionkey::bigint k from nation union all select r_regionkey from region")
_add("union_distinct", "MATCH (n:Nation) RETURN n.n_regionkey AS k UNION MATCH (r:Region) RETURN r.r_regionkey AS x", "select n_regionkey::bigint k from nation union select r_regionkey from region")
_add("unwind_literal", "UNWIND [1, 2, NULL, 3] AS x RETURN x, x * x AS y", "select x::bigint x, (x * x)::bigint y from (values (1), (2), (null), (3)) t(x)")
_add("unwind_column", "MATCH (n:Nation) UNWIND range(0, n.n_regionkey) AS i RETURN n.n_nationkey AS k, i", "select n_nationkey::bigint k, i from nation, range(0, 5) t(i) where i <= n_regionkey")
_add("unwind_collect", "MATCH (n:Nation) WITH n.n_regionkey AS r, collect(n.n_nationkey) AS l UNWIND l AS k RETURN r, k", "select n_regionkey::bigint r, n_nationkey::bigint k from nation")

# joins and expansion
_add("cross_join", "MATCH (a:Region), (b:Region) RETURN a.r_name AS a, b.r_name AS b", "select a.r_name a, b.r_name b from region a, region b")
_add("theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey RETURN a.n_nationkey AS a, b.n_nationkey AS b", "select a.n_nationkey::bigint a, b.n_nationkey::bigint b from nation a, nation b where a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
_add("shared_var_join", "MATCH (c:Customer)-[:CUST_NATION]->(n:Nation), (s:Supplier)-[:SUPP_NATION]->(n) RETURN n.n_nationkey AS k, count(*) AS n", "select n_nationkey::bigint k, count(*) n from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey group by 1")
_add("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 300000.0 RETURN c.c_name AS c, o.o_orderkey AS o", "select c_name c, o_orderkey o from customer join orders on o_custkey = c_custkey where o_totalprice > 300000")
_add("expand_in", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, n.n_name AS n", "select r_name r, n_name n from region join nation on n_regionkey = r_regionkey")
_add("expand_both", "MATCH (a:Nation)-[:TRADES]-(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"with {TRADES_SQL} select s a, d b from trades union all select d, s from trades")
_add("expand_rel_props", "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE l.returnflag = 'R' AND l.quantity > 45.0 RETURN p.p_brand AS b, count(*) AS n, sum(l.quantity) AS q", "select p_brand b, count(*) n, sum(l_quantity) q from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey where l_returnflag = 'R' and l_quantity > 45 group by 1")
_add("expand_rel_inline", "MATCH (o:Orders)-[:CONTAINS {returnflag: 'A'}]->(p:Part) RETURN count(*) AS n", "select count(*) n from lineitem where l_returnflag = 'A'")
_add("expand_multi_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUST_NATION]-(c:Customer)-[:PLACED]->(o:Orders)-[:CONTAINS]->(p:Part)-[:SUPPLIED_BY]->(s:Supplier) WHERE r.r_name = 'ASIA' AND p.p_size < 10 RETURN n.n_name AS n, count(*) AS c", "select n_name n, count(*) c from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem l on l_orderkey = o_orderkey join part on p_partkey = l_partkey join (select distinct l_partkey, l_suppkey from lineitem) s on s.l_partkey = p_partkey where r_name = 'ASIA' and p_size < 10 group by 1")
_add("expand_untyped", "MATCH (n:Nation)-[]-(x) RETURN n.n_nationkey AS k, count(*) AS c", f"with {TRADES_SQL}, x as (select n_nationkey k from nation union all select c_nationkey from customer union all select s_nationkey from supplier union all select s from trades union all select d from trades) select k::bigint k, count(*) c from x group by 1")
_add("expand_wrong_end", "MATCH (c:Customer)-[:IN_REGION]->(r:Region) RETURN c.c_custkey AS k", "select c_custkey k from customer where false")
_add("optional_one_hop", "MATCH (a:Nation) OPTIONAL MATCH (a)-[t:TRADES]->(b:Nation) WHERE t.w > 3000000.0 RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"with {TRADES_SQL} select n_nationkey::bigint a, d b from nation left join trades on s = n_nationkey and w > 3000000")
_add("optional_chain", "MATCH (s:Supplier) OPTIONAL MATCH (s)<-[:SUPPLIED_BY]-(p:Part) WHERE p.p_size = 7 OPTIONAL MATCH (p)<-[:CONTAINS]-(o:Orders) WHERE o.o_totalprice > 350000.0 RETURN s.s_suppkey AS s, count(p) AS p, count(o) AS o", "with ps as (select distinct l_partkey p, l_suppkey s from lineitem join part on p_partkey = l_partkey where p_size = 7), po as (select l_partkey p, l_orderkey o from lineitem join orders on o_orderkey = l_orderkey where o_totalprice > 350000) select s_suppkey s, count(ps.p) p, count(po.o) o from supplier left join ps on ps.s = s_suppkey left join po on po.p = ps.p group by 1")
_add("optional_leading", "OPTIONAL MATCH (n:Nation) WHERE n.n_nationkey > 99 RETURN n.n_name AS n", "select null::varchar n")
_add("exists", "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 300000.0 } RETURN c.c_custkey AS k", "select c_custkey k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
_add("exists_correlated", "MATCH (p:Part) WHERE EXISTS { MATCH (p)<-[l:CONTAINS]-(o:Orders) WHERE l.quantity > p.p_size + 40 } RETURN p.p_partkey AS k", "select p_partkey k from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > p_size + 40)")
_add("not_exists", "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)-[:PLACED]->(o:Orders) } RETURN c.c_custkey AS k", "select c_custkey k from customer where c_custkey not in (select o_custkey from orders)")
_add("exists_or", "MATCH (n:Nation) WHERE n.n_regionkey = 0 OR EXISTS { MATCH (n)-[t:TRADES]->(m:Nation) WHERE m.n_regionkey = n.n_regionkey } RETURN n.n_nationkey AS k", f"with {TRADES_SQL} select n_nationkey::bigint k from nation n where n_regionkey = 0 or exists (select 1 from trades join nation m on m.n_nationkey = d where s = n.n_nationkey and m.n_regionkey = n.n_regionkey)")
_add("call_subquery", "CALL { MATCH (o:Orders) RETURN avg(o.o_totalprice) AS mean } MATCH (o:Orders) WHERE o.o_totalprice > mean * 2 RETURN count(*) AS n", "select count(*) n from orders where o_totalprice > 2 * (select avg(o_totalprice) from orders)")

# paths
_WALK = "r(s, n, d) as (select n_nationkey::bigint, n_nationkey::bigint, 0 from nation union select r.s, e.b, r.d + 1 from r join e on e.a = r.n where r.d < {most}), near as (select s, n, min(d) d from r group by 1, 2)"


def _reach(least: int, most: int, both: bool = False) -> str:
    e = "e(a, b) as (select s, d from trades" + (" union select d, s from trades)" if both else ")")
    return f"with recursive {TRADES_SQL}, {e}, {_WALK.format(most=most)} select s a, n b from near where s <> n and d between {least} and {most}"


_add("varlen_1_1", "MATCH (a:Nation)-[:TRADES*1..1]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", _reach(1, 1))
_add("varlen_1_2", "MATCH (a:Nation)-[:TRADES*1..2]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", _reach(1, 2))
_add("varlen_1_3", "MATCH (a:Nation)-[:TRADES*..3]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", _reach(1, 3))
_add("varlen_just_1", "MATCH (a:Nation)-[:TRADES*1]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", _reach(1, 1))
_add("varlen_turns", "MATCH (a:Turn)-[:NEXT_TURN*2..4]->(b:Turn) RETURN a.id AS a, b.id AS b", f"with {TURNS_SQL} select x.id a, y.id b from turns x join turns y on x.conv_id = y.conv_id and y.turn - x.turn between 2 and 4 where (select count(*) from turns z where z.conv_id = x.conv_id and z.turn > x.turn and z.turn <= y.turn) = y.turn - x.turn")
_add("varlen_2_2", "MATCH (a:Nation)-[:TRADES*2]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", _reach(2, 2))
_add("varlen_left", "MATCH (b:Nation)<-[:TRADES*1..3]-(a:Nation) WHERE a.n_nationkey = 4 RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"select * from ({_reach(1, 3)}) where a = 4")
_add("varlen_both", "MATCH (a:Nation)-[:TRADES*1..2]-(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b", _reach(1, 2, True))
_add("varlen_star", "MATCH (a:Nation)-[:TRADES*]->(b:Nation) WHERE a.n_regionkey = 1 RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"select t.a, t.b from ({_reach(1, 25)}) t join nation on n_nationkey = a where n_regionkey = 1")
_add("shortest_path_len", "MATCH (a:Nation), (b:Nation), p = shortestPath((a)-[:TRADES*..6]->(b)) WHERE a.n_nationkey < 10 RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(p) AS l, size(nodes(p)) AS n", f"with recursive {TRADES_SQL}, e(a, b) as (select s, d from trades), {_WALK.format(most=6)} select s a, n b, d::bigint l, d::bigint n from near where s < 10")
_add("all_shortest_paths_count", "MATCH (a:Nation), (b:Nation), p = allShortestPaths((a)-[:TRADES*..6]->(b)) WHERE a.n_nationkey < 10 RETURN a.n_nationkey AS a, b.n_nationkey AS b, count(p) AS n", f"with recursive {TRADES_SQL}, e(a, b) as (select s, d from trades), {_WALK.format(most=6)}, c(s, n, d, path) as (select s, n, d, [n] from near where d = 0 and s < 10 union all select c.s, e.b, c.d + 1, list_append(c.path, e.b) from c join e on e.a = c.n join near on near.s = c.s and near.n = e.b and near.d = c.d + 1) select s a, n b, count(*) n from c group by 1, 2")
_add("path_least", "MATCH (a:Nation), (b:Nation), p = shortestPath((a)-[:TRADES*..5]->(b)) WHERE a.n_nationkey = 1 RETURN b.n_nationkey AS b, to_string(nodes(p)) AS p", f"with recursive {TRADES_SQL}, e(a, b) as (select s, d from trades), {_WALK.format(most=5)}, c(s, n, d, path) as (select s, n, d, [n] from near where d = 0 and s = 1 union all select c.s, e.b, c.d + 1, list_append(c.path, e.b) from c join e on e.a = c.n join near on near.s = c.s and near.n = e.b and near.d = c.d + 1) select n b, min(path)::varchar p from c group by 1")

# procedures
_add("algo_degree", "CALL degree_centrality('TRADES') YIELD node_id, out_degree, in_degree", f"with {TRADES_SQL} select n_nationkey::bigint node_id, (select count(*) from trades where s = n_nationkey) out_degree, (select count(*) from trades where d = n_nationkey) in_degree from nation")
_add("algo_wcc", "CALL wcc('NEXT_TURN') YIELD node_id, component_id", f"with recursive {TURNS_SQL}, r(id, root) as (select id, id from turns where id not in (select n from nxt) union all select nxt.n, r.root from r join nxt on nxt.f = r.id) select id node_id, root component_id from r")


def _pagerank_sql() -> str:
    steps = ["r0 as materialized (select n_nationkey::bigint v, 1.0::double / (select count(*) from nation) r from nation)"]
    for k in range(20):
        steps.append(
            f"r{k + 1} as materialized (select v, 0.15 / (select count(*) from nation) + 0.85 * coalesce((select sum(r) from r{k} where v not in (select s from trades)), 0) / (select count(*) from nation)"
            f" + 0.85 * coalesce((select sum(x.r / o.n) from r{k} x join trades t on t.s = x.v join outs o on o.s = t.s where t.d = y.v), 0) r from r{k} y)"
        )
    return f"with {TRADES_SQL}, outs as (select s, count(*) n from trades group by 1), {', '.join(steps)} select v node_id, round(r, 5) score from r20"


def _betweenness_sql() -> str:
    return f"""with recursive {TRADES_SQL}, e(a, b) as (select s, d from trades union select d, s from trades), {_WALK.format(most=25)},
c(s, n, d, k) as (select s, n, d, 1::hugeint from near where d = 0
  union all select s, b, d, sum(k)::hugeint from (select c.s, e.b, c.d + 1 d, c.k from c join e on e.a = c.n join near on near.s = c.s and near.n = e.b and near.d = c.d + 1) group by s, b, d),
g as (select c.s, c.n, c.d, c.k from c)
select n_nationkey::bigint node_id, round(coalesce((select sum(x.k::double * y.k / z.k) from g x join g y on y.s = x.n join g z on z.s = x.s and z.n = y.n and z.d = x.d + y.d
  where x.n = n_nationkey and x.s <> n_nationkey and y.n <> n_nationkey and x.s <> y.n), 0) / 2, 5) score from nation"""


def _lpa_sql() -> str:
    """Labels in a list by node, one step of the recursion a node, 100 rounds."""
    return f"""with recursive {TRADES_SQL}, near as (select v, list(u order by u) us from (select s v, d u from trades union select d, s from trades) group by v),
r(step, labels) as (select 0, (select list(n_nationkey::bigint order by n_nationkey) from nation) union all
  select step + 1, list_concat(list_concat(labels[1:v], [list_sort(list_transform(list_distinct(ls), lambda x: {{'c': -len(list_filter(ls, lambda y: y = x)), 'l': x}}))[1].l]), labels[v + 2:])
  from (select r.step, r.labels, near.v, list_transform(near.us, lambda u: r.labels[u + 1]) ls from r join near on near.v = r.step % 25 where r.step < 2500))
select unnest(range(25))::bigint node_id, unnest(labels) community from r where step = 2500"""


_NATIONS = (
    "COPY (MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.n_regionkey AS r) TO '{path}' (HEADER, DELIMITER ';')",
    "CREATE NODE TABLE N(k INT64, name STRING, r INT64, PRIMARY KEY(k)); COPY N FROM '{path}' (HEADER, DELIMITER ';')",
    "MATCH (n:N) RETURN n.k AS k, n.name AS name, n.r AS r",
)

#: Statements' numbers and the kinds of errors they end in.
_REFUSED_SQL = "select row_number() over () - 1 as k, error from (values {}) v(error)"

#: name -> (function of the session and folder, SQL)
OTHERS: dict[str, tuple[Callable[[GraphSession, str], DataFrame], str | None]] = {
    "algo_pagerank": (lambda g, d: g.call("pagerank", "TRADES").select("node_id", F.round("score", 5).alias("score")), _pagerank_sql()),
    "algo_betweenness": (lambda g, d: g.call("betweenness", "TRADES").select("node_id", F.round("score", 5).alias("score")), _betweenness_sql()),
    "algo_triangles": (
        lambda g, d: g.call("triangle_count", "COPURCHASED"),
        f"with {PAIRS_SQL}, t as (select x.a, x.b, y.b c from copurchased x join copurchased y on y.a = x.b join copurchased z on z.a = x.a and z.b = y.b), k as (select unnest([a, b, c]) v from t) select p_partkey node_id, (select count(*) from k where v = p_partkey) triangles from part",
    ),
    "algo_degree_copurchased": (
        lambda g, d: g.call("degree_centrality", "COPURCHASED"),
        f"with {PAIRS_SQL}, o as (select a v, count(*) n from copurchased group by 1), i as (select b v, count(*) n from copurchased group by 1) select p_partkey node_id, coalesce(o.n, 0) out_degree, coalesce(i.n, 0) in_degree from part left join o on o.v = p_partkey left join i on i.v = p_partkey",
    ),
    "algo_dijkstra": (
        lambda g, d: _all_costs(g),
        f"with recursive {TRADES_SQL}, r(n, c, path) as (select 0::bigint, 0.0::double, [0::bigint] union all select d, r.c + w, list_append(r.path, d) from r join trades on s = r.n where not list_contains(r.path, d) and len(r.path) < 12) select n_nationkey::bigint target, (select round(min(c), 2) from r where n = n_nationkey) as cost, (select array_to_string(arg_min(path, (c, path)), ',') from r where n = n_nationkey) as path from nation where n_nationkey in (1, 2, 3, 10)",
    ),
    "algo_lpa": (lambda g, d: g.call("label_propagation", "COPURCHASED"), None),
    "algo_lpa_trades": (lambda g, d: g.call("label_propagation", "TRADES"), _lpa_sql()),
    "dbms_tables": (
        lambda g, d: g.cypher("CALL dbms.tables() YIELD type, name"),
        "select unnest(['Region', 'Nation', 'Customer', 'Supplier', 'Part', 'Orders', 'Users', 'Event', 'Turn']) as name, 'NODE' as type union all"
        " select unnest(['IN_REGION', 'CUST_NATION', 'SUPP_NATION', 'PLACED', 'CONTAINS', 'SUPPLIED_BY', 'DID', 'TRADES', 'COPURCHASED', 'NEXT_TURN']), 'REL'",
    ),
    "csv_table_export": (lambda g, d: _csv(g, "COPY Region TO '{path}'", "CREATE NODE TABLE N(k INT64, name STRING, PRIMARY KEY(k)); COPY N FROM '{path}'", "MATCH (n:N) RETURN n.k AS k, n.name AS name"), "select r_regionkey::bigint k, r_name as name from region"),
    "dml_create": (lambda g, d: _written(g, "CREATE (a:P {id: 7, name: 'x'}), (b:P {id: 8})"), "select 7::bigint id, 'x' as name, null::double age union all select 8, null, null union all select 1, 'Ann', 30.0 union all select 2, 'Bob', null"),
    "dml_set": (lambda g, d: _written(g, "MATCH (p:P) WHERE p.id = 2 SET p.age = p.id * 10, p.name = 'Rob'"), "select 1::bigint id, 'Ann' as name, 30.0::double age union all select 2, 'Rob', 20.0"),
    "dml_delete": (lambda g, d: _written(g, "MATCH (p:P) WHERE p.name = 'Bob' DETACH DELETE p"), "select 1::bigint id, 'Ann' as name, 30.0::double age"),
    "dml_merge": (lambda g, d: _written(g, "MERGE (p:P {id: 2}) ON MATCH SET p.name = 'Met'; MERGE (p:P {id: 9}) ON CREATE SET p.name = 'New'"), "select 1::bigint id, 'Ann' as name, 30.0::double age union all select 2, 'Met', null union all select 9, 'New', null"),
    "dml_create_rel": (lambda g, d: _written(g, "MATCH (a:P), (b:P) WHERE a.id < b.id CREATE (a)-[:K {w: a.id + 0.5}]->(b)", "MATCH (a:P)-[k:K]->(b:P) RETURN a.id AS a, k.w AS w, b.id AS b"), "select 1::bigint a, 1.5::double w, 2::bigint b"),
    "dml_serial": (lambda g, d: _written(g, "CREATE NODE TABLE S(id SERIAL, v STRING, PRIMARY KEY(id)); CREATE (a:S {v: 'a'}); CREATE (a:S {v: 'b'})", "MATCH (s:S) RETURN s.id AS id, s.v AS v"), "select 0::bigint id, 'a' v union all select 1, 'b'"),
    "ddl_alter": (lambda g, d: _written(g, "ALTER TABLE P ADD COLUMN z INT64; ALTER TABLE P RENAME COLUMN name TO label; ALTER TABLE P DROP age; ALTER TABLE P RENAME TO Q", "MATCH (q:Q) RETURN q.id AS id, q.label AS label, q.z AS z"), "select 1::bigint id, 'Ann' as label, null::bigint z union all select 2, 'Bob', null"),
    "csv_round_trip": (lambda g, d: _csv(g, *_NATIONS), "select n_nationkey::bigint k, n_name as name, n_regionkey::bigint r from nation"),
    "csv_quoted_fields": (
        lambda g, d: _csv(
            g,
            "COPY (MATCH (n:Nation) RETURN n.n_nationkey AS k, concat('say \"', n.n_name, '\", or; ', to_string(n.n_regionkey)) AS name) TO '{path}' (HEADER, DELIMITER ',')",
            "CREATE NODE TABLE N(k INT64, name STRING, PRIMARY KEY(k)); COPY N FROM '{path}' (HEADER, DELIMITER ',')",
            "MATCH (n:N) RETURN n.k AS k, n.name AS name",
        ),
        "select n_nationkey::bigint k, 'say \"' || n_name || '\", or; ' || n_regionkey as name from nation",
    ),
    "csv_boolean_words": (
        lambda g, d: _csv(
            g,
            "COPY (MATCH (n:Nation) RETURN n.n_nationkey AS k, list_extract(['true', 'F', 'Yes', '0', 'T', 'NO', '1', 'false', '', 'NULL'], n.n_nationkey % 10 + 1) AS ok) TO '{path}'",
            "CREATE NODE TABLE N(k INT64, ok BOOL, PRIMARY KEY(k)); COPY N FROM '{path}'",
            "MATCH (n:N) RETURN n.k AS k, n.ok AS ok",
        ),
        "select n_nationkey::bigint k, [true, false, true, false, true, false, true, false, null, null][n_nationkey % 10 + 1] ok from nation",
    ),
    "csv_value_forms": (
        lambda g, d: _csv(
            g,
            "COPY (MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size % 2 = 0 AS even, p.p_size / 2.0 AS half, CASE WHEN p.p_size > 25 THEN p.p_brand END AS brand, [p.p_size, p.p_partkey] AS both) TO '{path}' (HEADER, DELIMITER '|')",
            "CREATE NODE TABLE N(k INT64, even STRING, half STRING, brand STRING, b STRING, PRIMARY KEY(k)); COPY N FROM '{path}' (HEADER, DELIMITER '|')",
            "MATCH (n:N) RETURN n.k AS k, n.even AS even, n.half AS half, n.brand AS brand, n.b AS b",
        ),
        "select p_partkey k, (p_size % 2 = 0)::varchar even, case when p_size % 2 = 0 then (p_size // 2)::varchar else (p_size / 2.0)::double::varchar end half, case when p_size > 25 then p_brand end brand, '[' || p_size || ',' || p_partkey || ']' b from part",
    ),
    "cast_refused": (lambda g, d: _refused(g, "RETURN CAST('2020-01-02' AS DATE) AS x", "RETURN CAST(1 AS DATETIME) AS x", "RETURN CAST(1.5 AS BOOL) AS x"), _REFUSED_SQL.format("('BindError'), ('BindError'), ('BindError')")),
    "star_refused": (lambda g, d: _refused(g, "RETURN lower(*) AS x", "MATCH (n:Nation) RETURN n.n_name + * AS x"), _REFUSED_SQL.format("('BindError'), ('SyntaxProblem')")),
    "hops_over_two_tables": (
        lambda g, d: _refused(g, "MATCH (c:Customer)-[:PLACED*1..2]->(o:Orders) RETURN count(*) AS n", "MATCH (c:Customer)-[:PLACED*1..1]->(o:Orders) RETURN count(*) AS n"),
        _REFUSED_SQL.format("('BindError'), (null)"),
    ),
    "dml_create_path": (lambda g, d: _written(g, "CREATE (a:P {id: 5})-[:K {w: 2.5}]->(b:P {id: 6})<-[:K]-(c:P {id: 7})", "MATCH (a:P)-[k:K]->(b:P) RETURN a.id AS a, k.w AS w, b.id AS b"), "select 5::bigint a, 2.5::double w, 6::bigint b union all select 7, null, 6"),
    "dml_detach": (
        lambda g, d: _written(g, "MATCH (a:P {id: 1}), (b:P {id: 2}) CREATE (a)-[:K {w: 1.0}]->(b); CREATE (c:P {id: 3})-[:K {w: 2.0}]->(e:P {id: 4}); MATCH (p:P {id: 2}) DETACH DELETE p", "MATCH (a:P) OPTIONAL MATCH (a)-[k:K]->(b:P) RETURN a.id AS a, k.w AS w"),
        "select 1::bigint a, null::double w union all select 3, 2.0 union all select 4, null",
    ),
    "key_violations": (
        lambda g, d: _refused(_people(g), "CREATE (a:P {id: 1})", "CREATE (a:P {id: 5}), (b:P {id: 5})", "CREATE (a:P {name: 'x'})", "MATCH (p:P {id: 2}) SET p.id = 1", "CREATE (a:P {id: 9})"),
        _REFUSED_SQL.format("('ConstraintError'), ('ConstraintError'), ('ConstraintError'), ('ConstraintError'), (null)"),
    ),
    "ddl_drop": (
        lambda g, d: _refused(_people(g), "DROP TABLE P", "DROP TABLE K", "DROP TABLE P", "DROP TABLE P", "MATCH (p:P) RETURN p.id AS id"),
        _REFUSED_SQL.format("('BindError'), (null), (null), ('BindError'), ('BindError')"),
    ),
    "failed_statement": (lambda g, d: _after_failure(g), "select 1::bigint id, 'Ann' as name, 30.0::double age union all select 2, 'Bob', null union all select 3, 'kept', null"),
    "read_only": (lambda g, d: _read_only(g), _REFUSED_SQL.format("('TransactionError'), ('TransactionError'), (null)")),
    "shell_session": (
        lambda g, d: _shell(g, "CREATE NODE TABLE P(id INT64,", "PRIMARY KEY(id));", "CREATE (a:P {id: 7});", "MATCH (p:P)", "RETURN p.id AS id;", "MATCH (p:Q) RETURN p;", ".schema P", ".database", ".nope", ".quit"),
        "select unnest(range(10))::bigint k, unnest(['', 'done', '+---+------+' || chr(10) || '| a | a.id |' || chr(10) || '+---+------+' || chr(10) || '| 0 | 7    |' || chr(10) || '+---+------+', '', '+----+' || chr(10) || '| id |' || chr(10) || '+----+' || chr(10) || '| 7  |' || chr(10) || '+----+', 'error', 'P (id bigint) key id', 'in memory', 'unknown command .nope; see .help', null]) said",
    ),
    "shell_completion": (
        lambda g, d: g.spark.createDataFrame([(w, ",".join(complete(w)), hint(w)) for w in ("MAT", ".t", ".che", "RETU", "", "zz")], "word string, found string, hint string"),
        "select unnest(['MAT', '.t', '.che', 'RETU', '', 'zz']) word, unnest(['MATCH', '.tables', '.checkpoint', 'RETURN', '', '']) as found, unnest(['CH', 'ables', 'ckpoint', 'RN', '', '']) hint",
    ),
    "prepared_param": (lambda g, d: g.prepare("MATCH (n:Nation) WHERE n.n_regionkey = $r RETURN n.n_name AS name").execute({"r": 3}), "select n_name as name from nation where n_regionkey = 3"),
    "script": (lambda g, d: g.execute_script("MATCH (r:Region) RETURN count(*) AS n; MATCH (n:Nation) RETURN count(*) AS n;"), "select count(*) n from nation"),
    "register_function": (lambda g, d: _with_function(g), "select n_name as name, n_regionkey::bigint + 100 x from nation"),
}


def _with_function(g: GraphSession) -> DataFrame:
    g.register_function("plus100", lambda c: c + 100)
    return g.cypher("MATCH (n:Nation) RETURN n.n_name AS name, plus100(n.n_regionkey) AS x")


def _all_costs(g: GraphSession) -> DataFrame:
    """Costs from nation 0 to four others, without a way NULL."""
    out = None
    for target in (1, 2, 3, 10):
        way = g.call("dijkstra", 0, target, "TRADES", "w").agg(F.min("cost").alias("cost"), F.min(F.concat_ws(",", "path")).alias("path")).select(F.lit(target).cast("bigint").alias("target"), F.round("cost", 2).alias("cost"), "path")
        out = way if out is None else out.unionAll(way)
    return out


def _written(g: GraphSession, script: str, read: str = "MATCH (p:P) RETURN p.id AS id, p.name AS name, p.age AS age") -> DataFrame:
    """Rows read back after a script over a small graph in memory."""
    fresh = _people(g)
    fresh.execute_script(script)
    return fresh.cypher(read)


def _people(g: GraphSession) -> GraphSession:
    fresh = GraphSession(g.spark)
    fresh.execute_script("CREATE NODE TABLE P(id INT64, name STRING, age DOUBLE, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, w DOUBLE); CREATE (a:P {id: 1, name: 'Ann', age: 30}), (b:P {id: 2, name: 'Bob'})")
    return fresh


def _refused(g: GraphSession, *statements: str) -> DataFrame:
    """Each statement's number and the kind of error it ends in, NULL if it works."""
    out = []
    for k, text in enumerate(statements):
        try:
            g.cypher(text).count()
            out.append((k, None))
        except GraphError as e:
            out.append((k, type(e).__name__))
    return g.spark.createDataFrame(out, "k bigint, error string")


def _after_failure(g: GraphSession) -> DataFrame:
    """A statement that worked, one that failed half-way, and what is there then."""
    fresh = _people(g)
    _refused(fresh, "CREATE (a:P {id: 3, name: 'kept'})", "CREATE (a:P {id: 4, name: 'lost'}), (b:P {id: 1})")
    return fresh.cypher("MATCH (p:P) RETURN p.id AS id, p.name AS name, p.age AS age")


def _read_only(g: GraphSession) -> DataFrame:
    reader = GraphSession(g.spark, read_only=True)
    reader.catalog = g.catalog
    return _refused(reader, "CREATE (r:Region {r_regionkey: 9})", "DROP TABLE TRADES", "MATCH (r:Region) RETURN count(*) AS n")


def _shell(g: GraphSession, *lines: str) -> DataFrame:
    """What the shell says to each line, without times and the wording of errors."""
    shell, out = Shell(g.spark), []
    for k, line in enumerate(lines):
        said = shell.feed(line)
        out.append((k, "error" if said and said.startswith("error") else re.sub(r"\n\([0-9.]+ s\)$", "", said) if said else said))
    return g.spark.createDataFrame(out, "k bigint, said string")


def _csv(g: GraphSession, out: str, into: str, read: str) -> DataFrame:
    """Rows written to a file in the shared folder, read into a new table and from there."""
    path = f"{shared_folder(g.spark)}/{os.urandom(8).hex()}.csv"
    g.cypher(out.format(path=path))
    back = GraphSession(g.spark)
    back.execute_script(into.format(path=path))
    return back.cypher(read)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, (text, params, _) in CYPHER.items():
        out[name] = lambda spark, d, text=text, params=params: star_graph(spark, d).cypher(text, params)
    for name, (run, _) in OTHERS.items():
        out[name] = lambda spark, d, run=run: run(star_graph(spark, d), d)
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (*_, sql) in [*CYPHER.items(), *OTHERS.items()] if sql}
