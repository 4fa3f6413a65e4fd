"""Typed views over the base tables, with deterministic stand-ins for columns and a table that the data lacks.

The text is valid in Spark SQL and in DuckDB. Stand-ins are arithmetic on keys,
so that both engines see the same rows. `partsupp` gives each part four suppliers
spread evenly over all of them. The value lists (modes, instructions, containers,
comment words) are fixed values of the schema's generator.
"""

from __future__ import annotations

import re

VIEWS = {
    "li": """
  select l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber,
    cast(l_quantity as decimal(15,2)) as l_quantity, cast(l_extendedprice as decimal(15,2)) as l_extendedprice,
    cast(l_discount as decimal(15,2)) as l_discount, cast(l_tax as decimal(15,2)) as l_tax,
    l_returnflag, l_linestatus, cast(l_shipdate as date) as l_shipdate,
    cast(l_shipdate as date) + cast((l_orderkey * 7 + l_linenumber * 3) % 61 - 30 as int) as l_commitdate,
    cast(l_shipdate as date) + cast(1 + (l_orderkey * 5 + l_linenumber) % 30 as int) as l_receiptdate,
    split_part('REG AIR|AIR|RAIL|SHIP|TRUCK|MAIL|FOB', '|', cast(1 + (l_orderkey + l_linenumber) % 7 as int)) as l_shipmode,
    split_part('DELIVER IN PERSON|COLLECT COD|NONE|TAKE BACK RETURN', '|', cast(1 + (l_orderkey + l_partkey) % 4 as int)) as l_shipinstruct
  from lineitem""",
    "ord": """
  select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice as decimal(15,2)) as o_totalprice,
    cast(o_orderdate as date) as o_orderdate, o_orderpriority, cast(0 as bigint) as o_shippriority,
    split_part('special packages requests|quick deposits|special accounts requests|even ideas|final requests', '|', cast(1 + o_orderkey % 5 as int)) as o_comment
  from orders""",
    "cust": """
  select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, cast(c_acctbal as decimal(15,2)) as c_acctbal, c_mktsegment,
    concat('Street ', cast(c_custkey % 977 as varchar(20))) as c_address,
    concat(cast(10 + c_nationkey as varchar(20)), '-', cast(100 + c_custkey % 900 as varchar(20)), '-', cast(1000 + c_custkey % 9000 as varchar(20))) as c_phone,
    split_part('regular|busy|silent', '|', cast(1 + c_custkey % 3 as int)) as c_comment
  from customer""",
    "sup": """
  select s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, cast(s_acctbal as decimal(15,2)) as s_acctbal,
    concat('Road ', cast(s_suppkey % 983 as varchar(20))) as s_address,
    concat(cast(10 + s_nationkey as varchar(20)), '-', cast(100 + s_suppkey % 900 as varchar(20))) as s_phone,
    case when s_suppkey % 40 = 7 then 'Customer has Complaints' else 'steady deliveries' end as s_comment
  from supplier""",
    "prt": """
  select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, cast(p_retailprice as decimal(15,2)) as p_retailprice,
    concat('Manufacturer#', cast(1 + p_partkey % 5 as varchar(20))) as p_mfgr,
    concat(split_part('SM|LG|MED|JUMBO|WRAP', '|', cast(1 + p_partkey % 5 as int)), ' ', split_part('CASE|BOX|BAG|JAR|PKG|PACK|CAN|DRUM', '|', cast(1 + p_partkey % 8 as int))) as p_container
  from part""",
    "ps": """
  select p.p_partkey as ps_partkey,
    (p.p_partkey + k.i * (cast(floor(n.suppliers / 4) as bigint) + cast(floor(p.p_partkey / n.suppliers) as bigint))) % n.suppliers as ps_suppkey,
    1 + (p.p_partkey * 37 + k.i * 1013) % 9999 as ps_availqty,
    cast(1 + (p.p_partkey * 13 + k.i * 709) % 1000 as decimal(15,2)) as ps_supplycost
  from part p
  cross join (select cast(0 as bigint) as i union all select 1 union all select 2 union all select 3) k
  cross join (select cast(floor(count(*) / 4) * 4 as bigint) as suppliers from supplier) n""",
}


def with_views(body: str) -> str:
    """Put the views that a query reads in front of it."""
    used = [n for n in VIEWS if re.search(rf"\b(from|join)\s+{n}\b", body)]
    head = ",\n".join(f"{n} as ({VIEWS[n]})" for n in used)
    body = body.strip()
    if not head:
        return body
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
