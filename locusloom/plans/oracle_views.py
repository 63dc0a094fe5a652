"""DuckDB text of the views in ``views.py``, used as the prefix of oracle queries."""

from __future__ import annotations

CTES = {
    "regions": """select concat('chr', cast(l_suppkey % 5 as varchar)) as chrom,
        cast(l_orderkey*100 + l_linenumber*13 as bigint) as "start",
        cast(l_orderkey*100 + l_linenumber*13 as bigint) + cast(l_quantity*2 as bigint) as "end",
        concat(l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '_', cast(round(l_extendedprice*100) as bigint)) as name,
        l_quantity as score from lineitem""",
    "rois": """select concat('chr', cast(o_custkey % 5 as varchar)) as chrom, o_orderkey*100 as "start",
        o_orderkey*100 + 40 as "end", concat('roi', o_orderkey) as name from orders where o_orderpriority = '1-URGENT'""",
    "blocks": """select o_orderkey as blockid, concat('chr', cast(o_custkey % 5 as varchar)) as tchrom, o_orderkey*100 as tstart,
        o_orderkey*100 + 60 as tend, concat('q', cast(o_orderkey % 3 as varchar)) as qchrom, o_orderkey*80 as qstart,
        o_orderkey*80 + 60 as qend, case when o_orderkey % 4 = 0 then -1 else 1 end as qstrand from orders""",
    "tblocks": """select tchrom as chrom, tstart as "start", tend as "end", concat('block', blockid) as name from blocks""",
    "tracks": """select event_type as sample, concat('chr', cast(user_id % 5 as varchar)) as chrom, (event_id // 25)*3750 as "start",
        (event_id // 25)*3750 + 1000 + 100*length(event_type) as "end", round(sum(value), 3) as value
        from events group by 1, 2, 3, 4""",
    "track": """select chrom, "start", max("end") as "end", round(sum(value), 3) as value from tracks group by 1, 2""",
    "sizes": """select chrom, max("end") + 100 as size from (select chrom, "end" from regions union all select chrom, "end" from tracks union all select chrom, "end" from tblocks) group by 1""",
    "seqs": """select doc_id, translate(regexp_replace(text, '[^A-Za-z]', 'N', 'g'),
        'bdefhijklmnopqrsuvwxyzBDEFGHIJKLMOPQRSUVWXYZ', 'acgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTA') as seq, lang
        from documents""",
    "motif_bins": """select concat('chr', cast(l_suppkey % 5 as varchar)) as chrom, ((l_orderkey*100 + l_linenumber*13) // 250)*250 as bin,
        concat(l_returnflag, l_linestatus) as motif, count(*) as n from lineitem group by 1, 2, 3""",
    "assoc": """select concat('chr', cast(o_custkey % 5 as varchar)) as chrom, concat('roi', o_orderkey) as name, i as idx,
        greatest(o_orderkey*100 + d, 0) as "start", greatest(o_orderkey*100 + d, 0) + 250 as "end", w as wt
        from orders, (values (0, -400, 1.0::double), (1, 300, 2.0::double), (2, 1500, 0.5::double)) as t(i, d, w)
        where o_orderpriority = '1-URGENT' and o_orderstatus = 'O'""",
    "cuts": """select chrom, pos as "start", lead(pos) over (partition by chrom order by pos) as "end"
        from (select chrom, "start" as pos from tracks union select chrom, "end" from tracks)""",
    "spans": """select c.chrom, c."start", c."end", t.sample, t.value from cuts c join tracks t
        on c.chrom = t.chrom and c."start" < t."end" and c."end" > t."start" where c."end" is not null""",
    "islands_of_blocks": """select chrom, min("start") as "start", max("end") as "end" from (
        select *, sum(case when prev is null or "start" > prev then 1 else 0 end) over (partition by chrom order by "start", "end") as g from (
        select *, max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as prev from tblocks))
        group by chrom, g""",
}

NEEDS = {
    "tblocks": ["blocks"],
    "track": ["tracks"],
    "sizes": ["regions", "tracks", "tblocks"],
    "cuts": ["tracks"],
    "spans": ["cuts", "tracks"],
    "islands_of_blocks": ["tblocks"],
}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views and what they need, ready to be continued."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order)
