"""Performance data derived from the driver's star schema, as SQL that Spark and DuckDB both run.

Each view carries collection_id.  The names begin with fx_ (samples, stacks, series) or tr_ (trace tables)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "fx_folded": """
select concat('c', cast(c.c_custkey % 3 as string)) as collection_id, concat_ws(';', c.c_mktsegment, r.r_name, nc.n_name, ns.n_name, p.p_type, p.p_brand) as stack,
 cast(sum(l.l_quantity) as bigint) as weight
from lineitem l join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey join nation nc on nc.n_nationkey = c.c_nationkey
 join region r on r.r_regionkey = nc.n_regionkey join supplier s on s.s_suppkey = l.l_suppkey join nation ns on ns.n_nationkey = s.s_nationkey join part p on p.p_partkey = l.l_partkey
group by 1, 2""",
    "fx_counters": """
select concat('c', cast(event_id % 3 as string)) as collection_id, event_id as ord, cast(floor(event_id / 100) as double) as timestamp, cast(user_id % 8 as int) as cpu_id,
 cast(round(value * 1000) as bigint) as value,
 case event_type when 'view' then 'cycles:D' when 'click' then 'instructions:D' when 'purchase' then 'ref-cycles:D' when 'error' then 'cache-misses:D' else 'branch-misses:D' end as metric_type,
 case when user_id % 5 = 0 then 75.0 else 100.0 end as run_pct
from events""",
    "fx_samples": """
select concat('c', cast(o.o_custkey % 3 as string)) as collection_id,
 cast(l.l_orderkey * 64 + row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as bigint) as ord,
 c.c_mktsegment as command, cast(o.o_custkey as int) as pid, cast(l.l_linenumber as int) as cpu,
 concat(cast(l.l_orderkey as string), '.', lpad(cast(l.l_linenumber * 1000 as string), 6, '0')) as time,
 cast(l.l_quantity as bigint) as value,
 case l.l_returnflag when 'R' then 'cycles' when 'A' then 'instructions' else 'cache-misses' end as event,
 concat('f', cast(p.p_partkey % 250 as string)) as addr0, concat(p.p_brand, '+0x', cast(p.p_partkey % 10 as string)) as symbol0, p.p_type as dso0,
 concat('5', cast(s.s_nationkey as string)) as addr1, case when s.s_nationkey % 5 = 0 then '[unknown]' else ns.n_name end as symbol1, 'libsupp.so' as dso1,
 concat('c', cast(c.c_nationkey as string)) as addr2, nc.n_name as symbol2, 'libcust.so' as dso2
from lineitem l join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey join nation nc on nc.n_nationkey = c.c_nationkey
 join supplier s on s.s_suppkey = l.l_suppkey join nation ns on ns.n_nationkey = s.s_nationkey join part p on p.p_partkey = l.l_partkey""",
    "fx_sar_cpu": """
select concat('c', cast(event_id % 3 as string)) as collection_id, cast(floor(event_id / 200) as int) as timestamp, cast(user_id % 8 as string) as cpu,
 coalesce(avg(case when event_type = 'view' then value end), 0) / 5.3 as pct_user, coalesce(avg(case when event_type = 'click' then value end), 0) / 8.7 as pct_system,
 coalesce(avg(case when event_type = 'error' then value end), 0) / 10.9 as pct_iowait, coalesce(avg(case when event_type = 'purchase' then value end), 0) / 4.7 as pct_idle
from events group by 1, 2, 3
union all
select concat('c', cast(event_id % 3 as string)), cast(floor(event_id / 200) as int), 'all',
 coalesce(avg(case when event_type = 'view' then value end), 0) / 5.3, coalesce(avg(case when event_type = 'click' then value end), 0) / 8.7,
 coalesce(avg(case when event_type = 'error' then value end), 0) / 10.9, coalesce(avg(case when event_type = 'purchase' then value end), 0) / 4.7
from events group by 1, 2""",
    "fx_sar_disk": """
select concat('c', cast(event_id % 3 as string)) as collection_id, cast(floor(event_id / 200) as int) as timestamp,
 case user_id % 6 when 0 then 'sda' when 1 then 'sdb' when 2 then 'nvme0n1' when 3 then 'nvme1n1' when 4 then 'dm-0' else 'loop0' end as dev,
 avg(case when event_type = 'view' then value end) / 1.0371 as pct_util, avg(case when event_type = 'click' then value end) / 1.0373 as await,
 avg(case when event_type = 'error' then value end) / 1.0377 as aqu_sz, avg(case when event_type = 'purchase' then value end) / 1.0379 as areq_sz,
 avg(case when event_type = 'signup' then value end) / 1.0381 as rkb_s
from events group by 1, 2, 3""",
    "fx_series": """
select concat('c', cast(event_id % 3 as string)) as collection_id, cast(floor(event_id / 50) as int) as timestamp,
 sum(case when event_type = 'view' then value else 0 end) as tps, coalesce(avg(case when event_type = 'click' then value end), 0) as await,
 coalesce(avg(case when event_type = 'error' then value end), 0) as pct_util, coalesce(avg(case when event_type = 'purchase' then value end), 0) as avgrq_sz,
 coalesce(avg(case when event_type = 'signup' then value end), 0) as avgqu_sz
from events group by 1, 2""",
    "fx_devices": """
select concat('c', cast(s_suppkey % 3 as string)) as collection_id, case when s_suppkey % 17 = 0 then concat('loop', cast(s_suppkey as string)) when s_suppkey % 2 = 0 then concat('nvme', cast(s_suppkey as string)) else concat('sd', cast(s_suppkey as string)) end as name,
 case when s_suppkey % 3 = 0 then 'HDD' else 'SSD' end as rotational, cast(1000 + s_suppkey as bigint) as size_bytes, cast(s_suppkey % 101 as double) as fs_percent, concat('/m', cast(s_suppkey as string)) as mount,
 s_suppkey % 4 <> 0 as parted, cast(500 + s_nationkey as bigint) as part_size, cast((s_suppkey * 7) % 101 as double) as part_percent
from supplier""",
    "fx_line_table": "select p_brand as module, cast(p_partkey * 10 as bigint) as addr_start, cast(p_size as int) as line, p_type as file from part",
    "fx_probe_addr": "select distinct p.p_brand as module, cast(l.l_partkey * 10 + l.l_linenumber as bigint) as addr from lineitem l join part p on p.p_partkey = l.l_partkey",
    "tr_machines": "select cast(r_regionkey as bigint) as id, cast(case when r_regionkey = 1 then -1 else r_regionkey end as bigint) as pid, r_name as root_dir from region",
    "tr_dsos": "select cast(n_nationkey as bigint) as id, cast(n_regionkey as bigint) as machine_id, n_name as short_name, concat('/lib/', n_name) as long_name, concat('b', cast(n_nationkey as string)) as build_id from nation",
    "tr_symbols": "select cast(p_partkey as bigint) as id, cast(p_partkey % 25 as bigint) as dso_id, cast(p_partkey * 100 as bigint) as sym_start, cast(p_partkey * 100 + 99 as bigint) as sym_end, cast(p_size % 3 as int) as binding, p_name as name from part",
    "tr_threads": "select cast(c_custkey as bigint) as id, cast(c_nationkey % 5 as bigint) as machine_id, cast(c_custkey as bigint) as process_id, cast(c_custkey as bigint) as pid, cast(c_custkey + 1 as bigint) as tid from customer",
    "tr_comms": "select cast(s_suppkey as bigint) as id, s_name as comm, cast(s_suppkey as bigint) as c_thread_id, cast(s_suppkey * 10 as bigint) as c_time, s_suppkey % 2 = 0 as exec_flag from supplier",
    "tr_comm_threads": "select cast(c_custkey as bigint) as id, cast(c_custkey % 10 as bigint) as comm_id, cast(c_custkey as bigint) as thread_id from customer",
    "tr_selected_events": "select cast(n_nationkey as bigint) as id, case n_nationkey when 0 then 'cbr' when 1 then 'mwait' when 2 then 'pwre' when 3 then 'exstop' when 4 then 'pwrx' else n_name end as name from nation",
    "tr_branch_types": "select cast(r_regionkey as bigint) as id, r_name as name from region",
    "tr_samples": """
select cast(l.l_orderkey * 64 + row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) as bigint) as id,
 cast(l.l_partkey % 25 as bigint) as evsel_id, cast(o.o_custkey as bigint) as thread_id, cast(l.l_suppkey as bigint) as comm_id, cast(l.l_partkey % 25 as bigint) as dso_id,
 cast(l.l_partkey as bigint) as symbol_id, cast(l.l_linenumber as bigint) as sym_offset, cast(l.l_orderkey * 16 as bigint) as ip, cast(l.l_orderkey as bigint) as time, cast(l.l_linenumber as int) as cpu,
 cast(l.l_suppkey % 25 as bigint) as to_dso_id, cast(l.l_partkey + 1 as bigint) as to_symbol_id, cast(0 as bigint) as to_sym_offset, cast(l.l_partkey * 32 as bigint) as to_ip,
 cast(l.l_linenumber % 5 as bigint) as branch_type, l.l_returnflag = 'R' as in_tx, cast(l.l_partkey as bigint) as call_path_id, cast(l.l_quantity * 10 as bigint) as insn_count,
 case when l.l_discount = 0 then cast(0 as bigint) else cast(l.l_quantity as bigint) + l.l_linenumber end as cyc_count, cast(l.l_linenumber % 3 as int) as flags
from lineitem l join orders o on o.o_orderkey = l.l_orderkey""",
    "tr_call_paths": "select cast(p_partkey as bigint) as id, cast(floor(p_partkey / 2) as bigint) as parent_id, cast(p_partkey as bigint) as symbol_id, cast(p_partkey * 16 as bigint) as ip from part",
    "tr_calls": """
select cast(o_orderkey as bigint) as id, cast(o_custkey as bigint) as thread_id, cast(o_custkey % 10 as bigint) as comm_id, cast(o_orderkey % 200 as bigint) as call_path_id, cast(o_orderkey as bigint) as call_time,
 cast(o_orderkey + cast(floor(o_totalprice) as bigint) as bigint) as return_time, cast(o_orderkey % 9 as bigint) as branch_count, cast(o_orderkey * 2 as bigint) as call_id, cast(o_orderkey * 2 + 1 as bigint) as return_id,
 cast(floor((o_orderkey % 200) / 2) as bigint) as parent_call_path_id, cast(o_orderkey % 7 as int) as flags, cast(o_orderkey - 1 as bigint) as parent_id,
 cast(o_custkey * 3 as bigint) as insn_count, case when o_orderkey % 11 = 0 then cast(0 as bigint) else cast(o_custkey + 7 as bigint) end as cyc_count
from orders""",
    "tr_raw_power": "select id, cast(evsel_id as int) as config, id * 4096 + symbol_id as payload from tr_samples where evsel_id < 6",
    "tr_ptwrite": "select id, payload, cast(payload % 2 as int) as exact_ip from tr_raw_power where config = 0",
    "tr_mwait": "select id, cast(payload % 256 as int) as hints, cast(floor(payload / 4294967296) as bigint) % 4 as extensions from tr_raw_power where config = 1",
    "tr_pwre": "select id, cast(floor(payload / 4096) as bigint) % 16 as cstate, cast(floor(payload / 256) as bigint) % 16 as subcstate, cast(floor(payload / 128) as bigint) % 2 as hw from tr_raw_power where config = 2",
    "tr_exstop": "select id, cast(payload % 2 as int) as exact_ip from tr_raw_power where config = 3",
    "tr_pwrx": "select id, payload % 16 as deepest_cstate, cast(floor(payload / 16) as bigint) % 16 as last_cstate, cast(floor(payload / 256) as bigint) % 16 as wake_reason from tr_raw_power where config = 4",
    "tr_cbr": "select id, cast(payload % 64 as int) as cbr, cast(payload % 5000 as int) as mhz, cast(payload % 100 as int) as percent from tr_raw_power where config = 5",
    "tr_context_switches": """
select cast(o_orderkey as bigint) as id, cast(0 as bigint) as machine_id, cast(o_orderkey as bigint) as time, cast(o_orderkey % 8 as int) as cpu, cast(o_custkey as bigint) as thread_out_id, cast(o_custkey % 10 as bigint) as comm_out_id,
 cast((o_custkey + 1) % 100 as bigint) as thread_in_id, cast((o_custkey + 3) % 10 as bigint) as comm_in_id, cast(o_orderkey % 4 as int) as flags from orders""",
}


def needed(sql: str) -> list[str]:
    """Views that a text names, and theirs, in an order in which they can be defined."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b(?:fx|tr)_\w+", text):
            if name not in out:
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """sql with its views in front, for an engine that has the base tables."""
    heads = [f"{n} as ({VIEWS[n].strip()})" for n in needed(sql)]
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {', '.join(heads)}, {body[5:]}"
    return f"with {', '.join(heads)} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view.  Where lines are numbered by order, they are dealt by order into as many parts as shuffles have, which keeps Spark
    from merging those: its limit counts compressed bytes, of which a task sorts many times as many in memory."""
    for t in TABLES:
        d = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "lineitem" and {"fx_samples", "tr_samples"} & set(needed(name)):
            d = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
        d.createOrReplaceTempView(t)
    return spark.sql(with_views(f"select * from {name}"))
