"""Text search, file inventory, copies, marts and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.operators import corpus, datachecks, textindex
from tallyward.session import scratch
from tallyward.sources import files, tables
from tallyward.sources.tables import load
from tallyward.suite.common import TABLES, Suite

SUITE = Suite()
add = SUITE.add

_PATTERN = r"th[ae]\w+ion"


def _docs(spark, folder):
    return load(spark, folder, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "text",
    )


_LINES = r"""
    docs as (select source || '/' || lang || '/doc_' || cast(doc_id as varchar) || '.txt' as path, string_split(regexp_replace(text, '\n$', ''), chr(10)) as l from documents),
    lines as (select path, l, unnest(generate_series(1, len(l))) as i from docs),
    found as (select path, i as line_number, l[i] as line_content, len(regexp_extract_all(l[i], '{p}')) as submatches, l from lines where regexp_matches(l[i], '{p}'))"""


@add(
    "t01_grep",
    f"""with {_LINES.format(p=_PATTERN)} select path, line_number, line_content, unnest(generate_series(1, submatches)) as submatch
        from found order by path, line_number, submatch limit 100""",
)
def t01(spark, folder):
    return corpus.grep(_docs(spark, folder), "path", "text", _PATTERN)


@add(
    "t01_grep_all",
    f"""with {_LINES.format(p='(?i)' + _PATTERN)} select path, line_number, unnest(generate_series(1, submatches)) as submatch
        from found where path like '%/en/%' and path not like 'src3/%' and path not like 'src1/%'""",
)
def t01_all(spark, folder):
    hits = corpus.grep(
        _docs(spark, folder), "path", "text", _PATTERN, None, ignore_case=True, glob="**/en/*.txt", ignore=["src3/", "src1"]
    )
    return hits.select("path", "line_number", "submatch")


@add(
    "t01_grep_totals",
    f"""with {_LINES.format(p=_PATTERN)} select sum(submatches)::bigint as total_matches, count(*) as lines, count(distinct path) as texts,
              sum(submatches) > 100 as truncated from found""",
)
def t01_totals(spark, folder):
    return corpus.grep_totals(_docs(spark, folder), "path", "text", _PATTERN)


@add(
    "t02_grep_context",
    f"""with {_LINES.format(p=_PATTERN)} select path, line_number, line_content,
              array_to_string(l[greatest(line_number - 2, 1):line_number - 1], '|') as before, array_to_string(l[line_number + 1:line_number + 2], '|') as after
        from found""",
)
def t02(spark, folder):
    hits = corpus.matching_lines(_docs(spark, folder), "path", "text", _PATTERN, context=2)
    return hits.select(
        "path",
        "line_number",
        "line_content",
        F.array_join("context_before", "|").alias("before"),
        F.array_join("context_after", "|").alias("after"),
    )


def _index(spark, folder):
    return textindex.write_index(_docs(spark, folder), "path", "text", scratch(spark, "index"), 16)


_LITERAL = "icensed under"


@add(
    "t01_grep_indexed",
    f"""with {_LINES.format(p=_LITERAL)} select path, line_number, line_content, unnest(generate_series(1, submatches)) as submatch from found""",
)
def t01_indexed(spark, folder):
    return textindex.grep(_index(spark, folder), _LITERAL, None)


@add("t01_grep_all_indexed", SUITE.oracles["t01_grep_all"])
def t01_all_indexed(spark, folder):
    hits = textindex.grep(
        _index(spark, folder), _PATTERN, None, ignore_case=True, glob="**/en/*.txt", ignore=["src3/", "src1"]
    )
    return hits.select("path", "line_number", "submatch")


@add(
    "t01_grep_totals_indexed",
    f"""with {_LINES.format(p='(?i)' + _LITERAL)} select sum(submatches)::bigint as total_matches, count(*) as lines, count(distinct path) as texts,
              sum(submatches) > 100 as truncated from found""",
)
def t01_totals_indexed(spark, folder):
    return textindex.grep_totals(_index(spark, folder), _LITERAL, ignore_case=True)


@add(
    "t03_find_documents",
    """with f as (select '/' || source || '/' || lang || '/doc_' || doc_id || '.txt' as path, '/' || source || '/' || lang as dir, n_chars as size, source, lang, doc_id
                  from documents)
       select path, dir, size from f where regexp_matches(path, '/en/doc_[^/]*7.txt$') and source not in ('src1', 'src3')""",
)
def t03_documents(spark, folder):
    """The documents as files of a folder for each source and language."""
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    listing = load(spark, folder, "documents").select(path.alias("path"), F.col("n_chars").alias("size"))
    return files.listed_files(listing, "en/doc_*7.txt", ignore=["src3/", "src1"])


@add("t03_find_files")
def t03(spark, folder):
    return files.find_files(spark, folder, "*.parquet", ignore=["embeddings.parquet"])


@add("t04_dir_summary")
def t04(spark, folder):
    return files.dir_summary(files.find_files(spark, folder))


@add(
    "t04_document_folders",
    """with f as (select '/' || source || '/' || lang as dir, n_chars as size from documents),
            direct as (select dir, count(*) as files, sum(size)::bigint as bytes from f group by 1),
            above as (select '/' as dir, count(distinct split_part(dir, '/', 2)) as folders from direct
                      union all select '/' || split_part(dir, '/', 2), count(distinct split_part(dir, '/', 3)) from direct group by 1),
            j as (select dir, coalesce(files, 0) as files, coalesce(folders, 0) as folders, coalesce(bytes, 0) as bytes from direct full join above using (dir))
       select dir, files, folders, bytes, files + folders as items from j""",
)
def t04_documents(spark, folder):
    listed = load(spark, folder, "documents").select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"), F.col("n_chars").alias("size")
    )
    return files.dir_summary(listed)


@add(
    "io1_copy_tables",
    " union all ".join(
        f"select '{t}' as table_name, (select count(*) from {t}) as rows, {n}::bigint as columns"
        for t, n in zip(TABLES, [2, 3, 5, 4, 6, 6, 11, 6, 5, 3, 3, 2, 3, 4])
    ),
)
def io1(spark, folder):
    return tables.copy_tables(spark, folder, scratch(spark, "copy"), TABLES)


@add("io1_copied_lines", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate from lineitem")
def io1_lines(spark, folder):
    target = scratch(spark, "copy")
    tables.copy_tables(spark, folder, target, ["lineitem"])
    return load(spark, target, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )


def _staged(spark, folder):
    customers = load(spark, folder, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"),
    )
    raw = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_returnflag").alias("payment_method"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    return customers, orders, tables.stage_payments(raw, "cents")


@add(
    "io2_order_mart",
    """with p as (select l_orderkey as order_id, l_returnflag as m, cast(round(l_extendedprice * 100) as bigint) / 100.0::double as amount from lineitem),
            a as (select order_id, round(coalesce(sum(amount) filter (where m = 'A'), 0), 2) as a_amount, round(coalesce(sum(amount) filter (where m = 'N'), 0), 2) as n_amount,
                         round(coalesce(sum(amount) filter (where m = 'R'), 0), 2) as r_amount, round(sum(amount), 2) as amount from p group by 1)
       select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as order_date, o_orderstatus as status, a_amount, n_amount, r_amount, amount
       from orders left join a on o_orderkey = order_id""",
)
def io2_orders(spark, folder):
    _, orders, payments = _staged(spark, folder)
    return tables.order_mart(orders, payments, ["A", "N", "R"])


@add(
    "io2_customer_mart",
    """with p as (select l_orderkey as order_id, sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0::double as amount from lineitem group by 1),
            c as (select o_custkey as customer_id, min(o_orderdate) as first_order, max(o_orderdate) as most_recent_order, count(*) as number_of_orders,
                         round(sum(amount), 2) as customer_lifetime_value from orders left join p on o_orderkey = order_id group by 1)
       select c_custkey as customer_id, c_name as name, first_order, most_recent_order, number_of_orders, customer_lifetime_value
       from customer left join c on c_custkey = customer_id""",
)
def io2_customers(spark, folder):
    customers, orders, payments = _staged(spark, folder)
    return tables.customer_mart(customers, tables.order_mart(orders, payments, ["A", "N", "R"]))


@add(
    "io3_check_keys",
    """with u as (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1),
            o as (select l_orderkey, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) group by 1),
            p as (select part_ref, count(*) as n from (select l_partkey + case when l_linenumber = 3 then 900000000 else 0 end as part_ref from lineitem) where part_ref not in (select p_partkey from part) group by 1)
       select 'l_orderkey,l_linenumber' as "constraint", 'unique' as kind, count(*) as bad_values, coalesce(sum(n), 0)::bigint as bad_rows from u
       union all select 'l_orderkey,l_linenumber', 'not_null', 0, count(*) from lineitem where l_orderkey is null or l_linenumber is null
       union all select 'l_orderkey', 'foreign', count(*), coalesce(sum(n), 0)::bigint from o
       union all select 'part_ref', 'foreign', count(*), coalesce(sum(n), 0)::bigint from p""",
)
def io3(spark, folder):
    # some references are led astray, so that parents are missing
    astray = F.when(F.col("l_linenumber") == 3, 900_000_000).otherwise(0)
    lines = load(spark, folder, "lineitem").withColumn("part_ref", F.col("l_partkey") + astray)
    foreign = {
        "l_orderkey": (load(spark, folder, "orders").select("o_orderkey"), "o_orderkey"),
        "part_ref": (load(spark, folder, "part").select("p_partkey"), "p_partkey"),
    }
    return datachecks.check_keys(lines, ["l_orderkey", "l_linenumber"], foreign)


@add(
    "io4_check_domain",
    """select 'o_orderstatus' as check_name, count(*) filter (where o_orderstatus not in ('O', 'F')) as bad_rows from orders
       union all select 'o_orderpriority', count(*) filter (where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) from orders
       union all select 'key_differs', count(*) filter (where o_orderkey = o_custkey) from orders""",
)
def io4(spark, folder):
    allowed = {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}
    tests = {"key_differs": F.col("o_orderkey") != F.col("o_custkey")}
    return datachecks.check_domain(load(spark, folder, "orders"), allowed, tests)


@add(
    "io5_append_and_scan",
    "select l_returnflag, count(*) as lines from lineitem group by 1",
)
def io5(spark, folder):
    target = scratch(spark, "append")
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    tables.append(lines.filter("l_returnflag = 'R'"), target, "lines")
    tables.append(lines.filter("l_returnflag <> 'R'"), target, "lines")
    return load(spark, target, "lines").groupBy("l_returnflag").agg(F.count("*").alias("lines"))
