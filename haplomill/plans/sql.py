"""Parts of the SQL that several queries are checked against."""

MAP_KNOTS = "(2000.0::DOUBLE, 0.0::DOUBLE), (15000.0, 0.02), (30000.0, 0.02), (60000.0, 0.09), (90000.0, 0.15)"
EPOCHS = "(0, 0.0::DOUBLE, 5000.0::DOUBLE, 0.0::DOUBLE, 200.0::DOUBLE), (1, 200.0, 20000.0, 0.04, NULL)"

CTE = {
    "geno": """geno AS (SELECT CAST(s AS INT) AS site, CAST(vec_id AS INT) AS hap,
  CAST(CAST(embedding[s + 1] AS DOUBLE) * 1000 > (s % 40 - 8) * 14 AS INT) AS g FROM embeddings, range(64) r(s))""",
    "sites": "sites AS (SELECT CAST(s AS INT) AS site, CAST(1000 + 1500 * s + (s * s) % 97 AS INT) AS pos FROM range(64) r(s))",
    "freq": """freq AS (SELECT *, ac / an AS af, least(ac, an - ac) AS mac, least(ac / an, 1 - ac / an) AS maf, CAST(ac / an > 0.5 AS INT) AS flipped
  FROM (SELECT site, CAST(sum(g) AS BIGINT) AS ac, count(*) AS an FROM geno GROUP BY site))""",
    "knots": f"""knots AS (SELECT pos, cm, lead(pos) OVER (ORDER BY pos) AS next_pos, lead(cm) OVER (ORDER BY pos) AS next_cm
  FROM (VALUES {MAP_KNOTS}) k(pos, cm))""",
    "cm_raw": """cm_raw AS (SELECT s.site, s.pos, CASE WHEN s.pos <= 2000 THEN 0.0::DOUBLE WHEN s.pos >= 90000 THEN 0.15::DOUBLE
  ELSE k.cm + (s.pos - k.pos) * (k.next_cm - k.cm) / (k.next_pos - k.pos) END AS cm
  FROM sites s LEFT JOIN knots k ON s.pos >= k.pos AND s.pos < k.next_pos)""",
    "coords": """coords AS (SELECT site, pos, cm FROM cm_raw WHERE site = 0 UNION ALL
  SELECT c.site, c.pos, CASE WHEN c.cm <= r.cm THEN r.cm + 1e-5 ELSE c.cm END FROM coords r JOIN cm_raw c ON c.site = r.site + 1)""",
    "epochs": f"epochs AS (SELECT * FROM (VALUES {EPOCHS}) e(k, t, ne, std, next_t))",
    "segs": """segs AS (SELECT CAST(vec_id AS INT) AS hap, CAST(b AS INT) AS seg_idx, s.pos AS start_bp, e.pos AS end_bp,
  CAST((7 * vec_id + 13 * b) % vec_id AS INT) AS target, CAST(100 + (37 * vec_id + 101 * b) % 997 AS DOUBLE) AS tmrca
  FROM embeddings CROSS JOIN range(4) r(b) JOIN sites s ON s.site = 16 * b LEFT JOIN sites e ON e.site = 16 * (b + 1) WHERE vec_id > 0)""",
    "mism": """mism AS (SELECT g.hap, g.site FROM geno g LEFT JOIN segs s ON s.hap = g.hap AND s.seg_idx = g.site // 16
  LEFT JOIN geno t ON t.site = g.site AND t.hap = s.target WHERE g.g <> coalesce(t.g, 0))""",
    # rank of each haplotype after each site, by the reversed string of its alleles so far
    "prefix": """prefix AS (SELECT site, hap, g, reverse(string_agg(CAST(g AS VARCHAR), '') OVER (PARTITION BY hap ORDER BY site)) AS key FROM geno)""",
    "ranks": "ranks AS (SELECT site, hap, g, CAST(row_number() OVER (PARTITION BY site ORDER BY key, hap) - 1 AS INT) AS rnk FROM prefix)",
    "kept": """kept AS (SELECT c.site, c.cm, c.cm - min(c.cm) OVER () AS off FROM coords c JOIN freq f ON f.site = c.site WHERE ac > 1 AND ac < an)""",
}
NEEDS = {
    "freq": ["geno"], "cm_raw": ["sites", "knots"], "coords": ["cm_raw"], "segs": ["sites"], "mism": ["geno", "segs"], "prefix": ["geno"],
    "ranks": ["prefix"], "kept": ["coords", "freq"],
}


def define(name: str, text: str, *needs: str) -> None:
    """Adds a common table expression."""
    CTE[name], NEEDS[name] = f"{name} AS ({text})", list(needs)


def sql(select: str, *names: str) -> str:
    """The statement with all common table expressions that the named ones need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(CTE[x] for x in order) + "\n" + select if order else select
