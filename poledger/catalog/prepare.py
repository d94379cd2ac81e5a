"""Dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from poledger.catalog.registry import query
from poledger.operators import prepare

# Base documents: one per order, with one to four pages.
_BASE = """
    SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, 'L' || CAST(o_custkey % 6 * (o_custkey % 2) + 1 AS VARCHAR) AS layout,
           o_custkey % 10 < 7 AS frequent, CAST(1 + o_orderkey % 4 AS INT) AS page_count, o_custkey AS issuer_id,
           'N' || CAST(o_orderkey % 700 AS VARCHAR) AS po_number FROM orders"""
V = {"base": _BASE}


def base(t):
    c = F.col("o_custkey")
    return t("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("L"), (c % 6 * (c % 2) + 1).cast("string")).alias("layout"), (c % 10 < 7).alias("frequent"),
        (1 + F.col("o_orderkey") % 4).cast("int").alias("page_count"), c.alias("issuer_id"),
        F.concat(F.lit("N"), (F.col("o_orderkey") % 700).cast("string")).alias("po_number"),
    )


def _pick(seed: str, n: int, where: str = "true") -> str:
    return f"""SELECT id FROM (SELECT id, layout, row_number() OVER (PARTITION BY layout ORDER BY md5('{seed}' || id), id) AS rank
               FROM base WHERE {where}) x ORDER BY rank, layout LIMIT {n}"""


@query("stratified_split", f"SELECT id, CASE WHEN id IN ({_pick('splits', 500)}) THEN 'dev' ELSE 'test' END AS split FROM base", V)
def stratified_split(t):
    return prepare.split(base(t), 500)


_REBALANCE = {
    "counts": "SELECT layout, count(id) AS n FROM (SELECT 'L' || CAST(i AS VARCHAR) AS layout FROM range(1, 7) r(i)) l LEFT JOIN base USING (layout) GROUP BY layout",
    "places": "SELECT new_layout, row_number() OVER (ORDER BY depth, new_layout) AS rank FROM (SELECT layout AS new_layout, unnest(range(n, 2000)) AS depth FROM counts WHERE n < 2000) p",
    "leaving": """SELECT id, row_number() OVER (ORDER BY height DESC, seq DESC) AS rank FROM (
        SELECT id, seq, n + 1 - row_number() OVER (PARTITION BY layout ORDER BY seq DESC) AS height FROM base JOIN counts USING (layout) WHERE NOT frequent) h WHERE height > 2000""",
}


@query("rebalance_layouts", "SELECT b.id, coalesce(p.new_layout, b.layout) AS layout FROM base b LEFT JOIN (leaving JOIN places p USING (rank)) ON leaving.id = b.id", {**V, **_REBALANCE})
def rebalance_layouts(t):
    return prepare.rebalance(base(t), 2000)


_MIXED = f"""
    SELECT id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS scanned_pages FROM (
        SELECT id, p, k, row_number() OVER (PARTITION BY id ORDER BY md5('mixed-p' || id || '/' || CAST(p AS VARCHAR)), p) AS rank FROM (
            SELECT id, unnest(range(1, page_count + 1)) AS p,
                   least(('0x' || left(md5('mixed-k' || id), 1))::INT % 2 + 1, page_count - 1) AS k
            FROM base WHERE id IN ({_pick('mixed', 300, "page_count > 1")})) a) b
    WHERE rank <= k GROUP BY id"""


@query("choose_mixed", "SELECT id, scanned_pages FROM mixed", {**V, "mixed": _MIXED})
def choose_mixed(t):
    return prepare.choose_mixed(base(t).filter("page_count > 1"), 300)


@query(
    "expand_variants",
    """SELECT base_id, doc, variant, page_kinds, 'pdfs/' || doc || '.pdf' AS pdf FROM (
         SELECT id AS base_id, id AS doc, 'N' AS variant, trim(repeat('native ', page_count)) AS page_kinds FROM base
         UNION ALL SELECT id, id || '_S', 'S', trim(repeat('scanned ', page_count)) FROM base
         UNION ALL SELECT b.id, b.id || '_M', 'M', array_to_string(list_transform(range(1, page_count + 1),
             lambda p: CASE WHEN list_contains(string_split(scanned_pages, ','), CAST(p AS VARCHAR)) THEN 'scanned' ELSE 'native' END), ' ')
           FROM base b JOIN mixed m ON m.id = b.id) x""",
    {**V, "mixed": _MIXED},
)
def expand_variants(t):
    b = base(t)
    return prepare.expand_variants(b, prepare.choose_mixed(b.filter("page_count > 1"), 300))


_REG = """
    SELECT buyer_gstin AS gstin, buyer_name AS name, 'buyer' AS role, 'I' || CAST(o_custkey AS VARCHAR) AS party_id, 1 AS priority FROM po_party
    UNION ALL SELECT vendor_gstin, vendor_name, 'vendor', '', 2 FROM po_party WHERE vendor_gstin IS NOT NULL"""


@query(
    "build_masters",
    """SELECT gstin, name, substr(gstin, 1, 2) AS state_code, role, party_id FROM (
         SELECT *, row_number() OVER (PARTITION BY gstin ORDER BY priority, party_id, name) AS rn FROM reg) x WHERE rn = 1""",
    {"reg": _REG},
)
def build_masters(t):
    p = t("po_party")
    buyers = p.select(F.col("buyer_gstin").alias("gstin"), F.col("buyer_name").alias("name"), F.lit("buyer").alias("role"),
                      F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("party_id"), F.lit(1).alias("priority"))
    vendors = p.select(F.col("vendor_gstin").alias("gstin"), F.col("vendor_name").alias("name"), F.lit("vendor").alias("role"),
                       F.lit("").alias("party_id"), F.lit(2).alias("priority"))
    return prepare.build_parties(buyers.unionByName(vendors))


@query(
    "master_items",
    "SELECT DISTINCT substr(issuer_gstin, 3, 10) AS pan, item_code FROM master_item",
)
def master_items(t):
    from poledger.sources import runs

    return runs.index_items(t("master_item"))


@query(
    "masters_index",
    "SELECT DISTINCT substr(issuer_gstin, 3, 10) AS pan, regexp_replace(upper(po_number), '[^A-Z0-9]', '', 'g') AS number FROM master_processed",
)
def masters_index(t):
    from poledger.sources import runs

    return runs.index_masters(t("master_item"), t("master_processed"))[1]


@query("unique_po_numbers", "SELECT issuer_id, po_number, min(id) AS id FROM base GROUP BY issuer_id, po_number", V)
def unique_po_numbers(t):
    return prepare.unique_numbers(base(t))


@query("expected_duplicates", "SELECT id FROM base WHERE frequent ORDER BY md5('duplicates' || id), id LIMIT 50", V)
def expected_duplicates(t):
    return prepare.expected_duplicates(base(t), 50)


@query(
    "format_po_number",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'PO/' || fy || '/' || lpad(serial, 5, '0') WHEN 1 THEN '45000' || lpad(serial, 5, '0')
              WHEN 2 THEN initials || '-PUR-' || strftime(po_date, '%y') || '-' || lpad(serial, 4, '0')
              WHEN 3 THEN initials || '/PO/' || serial || '/' || substr(fy, 3) ELSE 'PO-' || strftime(po_date, '%Y%m') || '-' || lpad(serial, 4, '0') END AS po_number
       FROM (SELECT doc_id, po_date, CAST(doc_id % 9999 + 1 AS VARCHAR) AS serial, upper(array_to_string(list_transform(regexp_extract_all(buyer_name, '[A-Za-z]+'), lambda w: left(w, 1)), '')) AS initials,
                    CASE WHEN month(po_date) >= 4 THEN year(po_date) || '-' || lpad(CAST((year(po_date) + 1) % 100 AS VARCHAR), 2, '0')
                         ELSE (year(po_date) - 1) || '-' || lpad(CAST(year(po_date) % 100 AS VARCHAR), 2, '0') END AS fy FROM po_party) x""",
)
def format_po_number(t):
    styles = F.array(*[F.lit(s) for s in prepare.SERIAL_DIGITS])
    style = F.get(styles, (F.col("doc_id") % 5).cast("int"))
    number = prepare.format_number(style, prepare.initials(F.col("buyer_name")), F.col("po_date"), F.col("doc_id") % 9999 + 1)
    return t("po_party").select("doc_id", number.alias("po_number"))


@query(
    "sample_per_template",
    """SELECT template, name FROM (SELECT template, name, row_number() OVER (PARTITION BY template ORDER BY md5('templates' || name), name) AS rn
       FROM (SELECT doc_id % 50 AS template, 'Template' || CAST(doc_id % 50 AS VARCHAR) || '_Instance' || CAST(doc_id AS VARCHAR) || '.jpg' AS name FROM documents) n) x
       WHERE rn = 1""",
)
def sample_per_template(t):
    d = F.col("doc_id")
    names = t("documents").select(
        (d % 50).alias("template"),
        F.concat(F.lit("Template"), (d % 50).cast("string"), F.lit("_Instance"), d.cast("string"), F.lit(".jpg")).alias("name"),
    )
    return prepare.sample_per_template(names)


@query(
    "dataset_profile",
    """SELECT layout, count(*) AS docs, min(line_count) AS lines_min, max(line_count) AS lines_max, CAST(sum(line_count) AS BIGINT) AS lines,
              count(*) FILTER (WHERE frequent) AS frequent, count(*) FILTER (WHERE seq % 6 = 0) AS terms_pages
       FROM (SELECT b.*, coalesce(n, 0) AS line_count FROM base b LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) l
             ON l.l_orderkey = b.seq) x GROUP BY layout""",
    V,
)
def dataset_profile(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("line_count"))
    docs = base(t).join(n, "seq", "left").fillna({"line_count": 0}).withColumn("has_terms", F.col("seq") % 6 == 0)
    return prepare.profile(docs)
