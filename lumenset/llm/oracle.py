"""The same results in SQL, on the same tables."""

from __future__ import annotations

_VALID = "regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}')"
_BITS = "('0x' || lower(trim(phash)))::UBIGINT"
_SOURCE = "nullif(regexp_replace(lower(trim(dataset_source)), '/$', ''), '')"
_TOKENS = r"coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')), 0)"

_LINKS = """
  imgs AS (SELECT DISTINCT path FROM deduped_index WHERE path IS NOT NULL),
  cleaned AS (SELECT regexp_replace(trim(path_a), '^\\./', '') AS a, regexp_replace(trim(path_b), '^\\./', '') AS b
              FROM match_pairs WHERE distance IS NULL OR distance <= 8),
  links AS (SELECT DISTINCT a, b FROM cleaned WHERE a <> b AND a IN (SELECT path FROM imgs) AND b IN (SELECT path FROM imgs)),
  ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach(path, other) AS (SELECT DISTINCT a, a FROM ways UNION SELECT r.path, w.b FROM reach r JOIN ways w ON r.other = w.a),
  grp AS (SELECT path, min(other) AS group_path FROM reach GROUP BY path)
"""
_RELATED = f"""
  imgs AS (SELECT DISTINCT path FROM split_index WHERE path IS NOT NULL),
  keyed AS (SELECT DISTINCT path, 'c' || cluster_id AS k FROM split_index WHERE path IS NOT NULL AND trim(cluster_id) <> ''
            UNION SELECT DISTINCT path, 'h' || lower(trim(phash)) FROM split_index WHERE path IS NOT NULL AND {_VALID}),
  heads AS (SELECT k, min(path) AS head FROM keyed GROUP BY k),
  ways AS (SELECT DISTINCT path AS a, head AS b FROM keyed JOIN heads USING (k) UNION SELECT DISTINCT head, path FROM keyed JOIN heads USING (k)),
  reach(path, other) AS (SELECT path, path FROM imgs UNION SELECT r.path, w.b FROM reach r JOIN ways w ON r.other = w.a),
  grp AS (SELECT path, min(other) AS group_path FROM reach GROUP BY path)
"""
_NEAR = f"""
  hashed AS (SELECT DISTINCT path, {_BITS} AS h FROM {{table}} WHERE path IS NOT NULL AND {_VALID})
"""
_SCORED = f"""
  img AS (SELECT path, {_SOURCE} AS source, max(CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END) AS s FROM sampled_index WHERE path IS NOT NULL GROUP BY 1, 2),
  best AS (SELECT path, source, max(s) OVER (PARTITION BY path) AS score FROM img)
"""
_STRATA = f"""
  img AS (SELECT DISTINCT path, lower(trim(class_label)) AS label, {_SOURCE} AS source FROM sampled_index WHERE path IS NOT NULL),
  size AS (SELECT count(DISTINCT path) // 3 AS n FROM img),
  strata AS (SELECT stratum_id, lower(trim(class_label)) AS label, {_SOURCE} AS source, target_permille, min_rows FROM stratum_targets),
  held AS (SELECT stratum_id, count(path) AS available, target_permille, min_rows
           FROM strata LEFT JOIN img USING (label, source) GROUP BY stratum_id, target_permille, min_rows)
"""
#: Minima first where they exceed the share of what is left, then shares in proportion, rounded by the largest remainder.
_WANTED = f"""{_STRATA},
  base AS (SELECT *, coalesce(min_rows, 0)::BIGINT AS m, coalesce(target_permille, 0)::BIGINT AS t, (SELECT n FROM size) * (SELECT sum(coalesce(target_permille, 0)) FROM strata)::BIGINT // 1000 AS total FROM held),
  inorder AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN t = 0 AND m > 0 THEN 0 WHEN t > 0 THEN 1 ELSE 2 END, m::DOUBLE / nullif(t, 0) DESC NULLS LAST, stratum_id) AS k FROM base),
  fixed AS (SELECT *, m * (SELECT sum(o.t) FROM inorder o WHERE o.k >= i.k) > t * (total - coalesce((SELECT sum(o.m) FROM inorder o WHERE o.k < i.k), 0)) AS at_least FROM inorder i),
  rest AS (SELECT any_value(total)::HUGEINT - coalesce(sum(m) FILTER (at_least), 0) AS left_over, coalesce(sum(t) FILTER (NOT at_least), 0) AS among FROM fixed),
  cut AS (SELECT f.*, CASE WHEN at_least OR among = 0 THEN m ELSE t * left_over // among END AS whole, CASE WHEN at_least OR among = 0 THEN -1 ELSE t * left_over % among END AS part FROM fixed f, rest),
  wanted AS (SELECT stratum_id, available, min_rows, target_permille, (whole + CASE WHEN part > 0 AND row_number() OVER (ORDER BY part DESC, stratum_id) <= (SELECT left_over FROM rest) - (SELECT coalesce(sum(whole), 0) FROM cut WHERE NOT at_least) THEN 1 ELSE 0 END)::BIGINT AS wanted FROM cut)
"""
_MIX = f"""
  sized AS (SELECT lower(trim(source)) AS name, {_TOKENS} AS n FROM documents),
  total AS (SELECT sum(n) AS t FROM sized),
  held AS (SELECT m.source, m.target_permille, m.max_repeats, coalesce(sum(s.n), 0) AS tokens
           FROM mix_targets m LEFT JOIN sized s ON s.name = lower(trim(m.source)) GROUP BY ALL)
"""


def oracle_sql() -> dict[str, str]:
    near_d, near_e = _NEAR.replace("{table}", "deduped_index"), _NEAR.replace("{table}", "export_index")
    sides = """
  sides AS (SELECT path, bool_or(lower(trim(split)) = 'train') AS tr, bool_or(lower(trim(split)) IN ('val', 'test')) AS ev FROM export_index WHERE path IS NOT NULL GROUP BY path),
  md AS (SELECT DISTINCT path, lower(trim(md5_hash)) AS m FROM export_index WHERE path IS NOT NULL AND trim(md5_hash) <> ''),
  cand AS (SELECT a.path AS pa, b.path AS pb, 1 - bit_count(xor(a.h, b.h)) / 64 AS coverage FROM hashed a JOIN hashed b ON a.path < b.path AND bit_count(xor(a.h, b.h)) <= 8
           UNION ALL SELECT a.path, b.path, 1 FROM md a JOIN md b ON a.m = b.m AND a.path < b.path),
  pairs AS (SELECT pa AS path_a, pb AS path_b, max(coverage) AS coverage FROM cand JOIN sides x ON x.path = pa JOIN sides y ON y.path = pb
            WHERE (x.tr AND y.ev) OR (x.ev AND y.tr) GROUP BY ALL),
  rec AS (SELECT DISTINCT path, lower(trim(split)) AS split, """ + _SOURCE + """ AS dataset_source FROM export_index WHERE path IS NOT NULL AND lower(trim(split)) IN ('val', 'test')),
  ends AS (SELECT path_a AS path, path_b AS other, coverage FROM pairs UNION ALL SELECT path_b, path_a, coverage FROM pairs),
  met AS (SELECT e.path, count(*) AS partners, max(coverage) AS coverage FROM ends e JOIN sides s ON s.path = e.other AND s.tr GROUP BY e.path),
  byrec AS (SELECT r.path, r.split, r.dataset_source, coalesce(partners, 0)::BIGINT AS partners, coalesce(coverage, 0)::DOUBLE AS coverage FROM rec r LEFT JOIN met USING (path))
"""
    out = {
        "p1_found": f"WITH RECURSIVE {_LINKS} SELECT group_path, path FROM grp",
        "p1_image_groups": f"""WITH RECURSIVE {_LINKS}, hashes AS (SELECT path, min(CASE WHEN {_VALID} THEN lower(trim(phash)) END) AS phash FROM deduped_index WHERE path IS NOT NULL GROUP BY path)
            SELECT path, phash, coalesce(group_path, path) AS group_path FROM hashes LEFT JOIN grp USING (path)""",
        "p2_found": f"""WITH RECURSIVE {_RELATED}, s AS (SELECT DISTINCT path, lower(trim(split)) AS split FROM split_index WHERE path IS NOT NULL AND trim(split) <> ''),
            mixed AS (SELECT group_path FROM grp JOIN s USING (path) GROUP BY group_path HAVING count(DISTINCT split) > 1)
            SELECT group_path, path FROM grp WHERE group_path IN (SELECT group_path FROM mixed)""",
        "p2_facts": f"""WITH RECURSIVE {_RELATED} SELECT count(*) AS images, count(*) AS paths, (SELECT count(*) FROM split_targets)::BIGINT AS splits, 0::BIGINT AS divided_groups, count(DISTINCT group_path) AS groups, 0::BIGINT AS far_shares FROM grp""",
        "p3_found": f"WITH {near_e}, {sides} SELECT path_a, path_b FROM pairs",
        "p3_overlap_by_record": f"WITH {near_e}, {sides} SELECT * FROM byrec",
        "p3_overlap_report": f"WITH {near_e}, {sides} SELECT split, dataset_source, count(*) AS images, count(*) FILTER (partners > 0) AS overlapping, sum(partners)::BIGINT AS pairs, round(avg(coverage), 6) AS mean_coverage FROM byrec GROUP BY split, dataset_source",
        "p4_found": f"""WITH {_SCORED}, cap AS (SELECT count(DISTINCT path) * 5 // 100 AS n FROM img),
            ranked AS (SELECT path, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, path) AS r FROM best WHERE source IS NOT NULL)
            SELECT DISTINCT path FROM ranked WHERE r > (SELECT n FROM cap)""",
        "p4_kept_by_output_share": f"""WITH {_SCORED}, n AS (SELECT source, count(*) AS n FROM best WHERE source IS NOT NULL GROUP BY source),
            level AS (SELECT max(c) AS cap FROM (SELECT unnest(range(1, (SELECT max(n) + 1 FROM n))) AS c) WHERE c <= 0.05 * (SELECT sum(least(n, c)) FROM n) + 1e-9),
            ranked AS (SELECT source, path, score, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, path) AS r FROM best WHERE source IS NOT NULL)
            SELECT source, path, score FROM ranked WHERE r <= (SELECT cap FROM level)""",
        "p5_found": f"WITH {_STRATA} SELECT stratum_id FROM held, size WHERE available < min_rows OR available * 1000 < target_permille * n",
        "p5_report": f"""WITH {_WANTED}
            SELECT stratum_id, available, wanted, least(available, wanted) AS drawn, min_rows, target_permille, wanted - least(available, wanted) AS deficit FROM wanted""",
        "p5_counts": f"WITH {_WANTED} SELECT stratum_id, least(available, wanted) AS n, least(available, wanted) AS paths, 0::BIGINT AS foreign FROM wanted",
        "p6_found": f"WITH {near_d} SELECT DISTINCT a.path AS path_a, b.path AS path_b FROM hashed a JOIN hashed b ON a.path < b.path AND bit_count(xor(a.h, b.h)) <= 8",
        "p6_groups": f"""WITH RECURSIVE {near_d}, pairs AS (SELECT DISTINCT a.path AS a, b.path AS b FROM hashed a JOIN hashed b ON a.path < b.path AND bit_count(xor(a.h, b.h)) <= 8),
            ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
            reach(path, other) AS (SELECT DISTINCT path, path FROM deduped_index WHERE path IS NOT NULL UNION SELECT r.path, w.b FROM reach r JOIN ways w ON r.other = w.a),
            grp AS (SELECT path, min(other) AS group_path FROM reach GROUP BY path), links AS (SELECT a AS path, count(*) AS links FROM ways GROUP BY a)
            SELECT path, group_path, coalesce(links, 0)::BIGINT AS links FROM grp LEFT JOIN links USING (path)""",
        "p8_found": f"SELECT DISTINCT doc_id FROM documents WHERE {_TOKENS} > 2048",
        "p8_facts": f"""WITH n AS (SELECT {_TOKENS} AS n FROM documents)
            SELECT sum(ceil(n / 2048.0))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, 0::BIGINT AS odd, 0::BIGINT AS overfull, 0::BIGINT AS lost FROM n""",
        "p9_facts": f"WITH {_MIX} SELECT source, tokens * max_repeats * 1000 < target_permille * t AS short, 0::BIGINT AS too_often, 0::BIGINT AS foreign, 0::BIGINT AS missized, 0::BIGINT AS twice, false AS off FROM held, total",
        "p9_found": f"WITH {_MIX} SELECT source FROM held, total WHERE tokens * max_repeats * 1000 < target_permille * t",
    }
    return out
