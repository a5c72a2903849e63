"""The same results in SQL, on the same tables.

Written from the definitions of the operators, with windows and subqueries where the
operators use combinable aggregates, so that either checks the other.
"""

from __future__ import annotations

#: Where the drifting fields stand in the test files.
_PLACES = {
    "attention_head": ["attention_head", "attentionHead", "attn_head", "head.attention", "attention"],
    "use_fft": ["use_fft", "useFFT", "enable_fft", "fft", "preprocessing.fft"],
    "backbone": ["backbone", "backbone_name", "arch", "network", "net.backbone"],
}

_SRC = "nullif(regexp_replace(lower(trim(dataset_source)), '/$', ''), '')"


def _low(c: str) -> str:
    return f"nullif(lower(trim({c})), '')"


def _m(table: str = "deduped_index", extra: str = "", name: str = "m") -> str:
    """The manifest in normal form."""
    return f"""{name} AS (SELECT row_idx, path, {_SRC} AS dataset_source, {_low("class_label")} AS class_label, width, height, aspect_ratio, nullif(trim(format), '') AS format, file_size_bytes,
      {_low("md5_hash")} AS md5_hash, {_low("sha256")} AS sha256, {_low("phash")} AS phash, CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END AS quality_score,
      list_filter(quality_flag, lambda x: x <> 'ok') AS quality_flag, blur_score{extra} FROM {table})"""


_SPLIT = ", " + _low("split") + " AS split, nullif(trim(cluster_id), '') AS cluster_id"
_MS = _m("split_index", _SPLIT)
_ME = _m("export_index", _SPLIT + ", export_path")
_PREF = "coalesce(quality_score, 0) DESC, coalesce(width, 0)::DOUBLE * coalesce(height, 0) DESC, coalesce(file_size_bytes, 0) DESC, coalesce(path, ''), row_idx"

_FLAGS = """list_filter([CASE WHEN blur_score IS NULL THEN 'opencv_read_failed' WHEN blur_score < 80 THEN 'blurry' END,
    CASE WHEN NOT coalesce(width >= 256 AND height >= 256, false) THEN 'low_resolution' END,
    CASE WHEN NOT coalesce(aspect_ratio BETWEEN 0.5 AND 2.0, false) THEN 'aspect_ratio_extreme' END,
    CASE WHEN coalesce(lower(format) = 'jpeg' AND width > 0 AND height > 0 AND file_size_bytes / (width::BIGINT * height::BIGINT) < 0.15, false) THEN 'compressed' END], lambda x: x IS NOT NULL)"""
_COST = "CASE x WHEN 'corrupt' THEN 1.0::DOUBLE WHEN 'low_resolution' THEN 0.3::DOUBLE WHEN 'blurry' THEN 0.4::DOUBLE WHEN 'aspect_ratio_extreme' THEN 0.2::DOUBLE WHEN 'compressed' THEN 0.1::DOUBLE WHEN 'opencv_read_failed' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END"
_FLAGGED = f"""flagged AS (SELECT *, {_FLAGS} AS flags FROM m),
    scored AS (SELECT * REPLACE (greatest(0::DOUBLE, 1::DOUBLE - least(coalesce(list_sum(list_transform(flags, lambda x: {_COST})), 0::DOUBLE), 1::DOUBLE)) AS quality_score) FROM flagged)"""
_EXACT = f"""exact AS (SELECT * FROM m WHERE md5_hash IS NULL UNION ALL
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY md5_hash ORDER BY {_PREF}) AS rn FROM m WHERE md5_hash IS NOT NULL) WHERE rn = 1)"""


def _near(src: str) -> str:
    """Components of near hashes within buckets of four digits, over the rows of ``src``. A text that is no hexadecimal number tells nothing, so rows that share one are not alike."""
    return f"""hs AS (SELECT DISTINCT phash AS h, substr(phash, 1, 4) AS b, ('0x' || phash)::UBIGINT AS v FROM {src} WHERE regexp_full_match(phash, '[0-9a-f]{{16}}')),
      np AS (SELECT x.b AS bucket, x.h AS h1, y.h AS h2, bit_count(xor(x.v, y.v))::INTEGER AS distance FROM hs x JOIN hs y ON x.b = y.b AND x.h < y.h AND bit_count(xor(x.v, y.v)) <= 8),
      ways AS (SELECT h1 AS a, h2 AS b FROM np UNION ALL SELECT h2, h1 FROM np),
      reach(a, z) AS (SELECT DISTINCT a, a FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.z = w.a),
      comp AS (SELECT a, min(z) AS c FROM reach GROUP BY a),
      marks AS (SELECT phash AS mark FROM {src} WHERE NOT regexp_full_match(phash, '[0-9a-f]+') GROUP BY 1 HAVING count(*) > 1),
      clu AS (SELECT s.*, CASE WHEN length(phash) >= 4 AND mark IS NULL THEN coalesce(c, phash) END AS cluster_key FROM {src} s LEFT JOIN comp ON a = phash LEFT JOIN marks ON mark = phash)"""


_SINGLES = "single AS (SELECT * REPLACE (coalesce(cluster_key, 'path:' || path) AS cluster_key) FROM clu)"
_GOAL = "goal(class_label, target) AS (VALUES ('real', 400), ('ai_generated', 300), ('ai_edited', 200))"


def _class_sample(src: str) -> str:
    return f"""{_GOAL}, insrc AS (SELECT s.*, target, row_number() OVER (PARTITION BY s.class_label, dataset_source ORDER BY {_PREF}) AS k FROM {src} s JOIN goal USING (class_label)),
      incls AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY (k > floor(target * 0.2::DOUBLE))::INT, {_PREF}) AS r FROM insrc),
      picked AS (SELECT * FROM incls WHERE r <= target)"""


_PRED = "p AS (SELECT 'run_' || (vec_id % 4) AS run, vec_id AS sample_id, (label % 3)::INTEGER AS y_true, ((list_position(embedding, list_max(embedding)) - 1) % 3)::INTEGER AS y_pred FROM embeddings)"
_CUBE = f"{_PRED}, c AS (SELECT run, y_true, y_pred, count(*) AS n FROM p GROUP BY ALL)"
_REPORT = f"""{_CUBE}, t AS (SELECT run, y_true AS label, sum(n) AS support, sum(n) FILTER (y_true = y_pred) AS tp FROM c GROUP BY 1, 2), q AS (SELECT run, y_pred AS label, sum(n) AS predicted FROM c GROUP BY 1, 2),
  rep AS (SELECT run, label, round(coalesce(coalesce(tp, 0) / nullif(predicted, 0), 0)::DOUBLE, 6) AS precision, round(coalesce(coalesce(tp, 0) / nullif(support, 0), 0)::DOUBLE, 6) AS recall,
    round((2 * coalesce(tp, 0) / nullif(coalesce(predicted, 0) + coalesce(support, 0), 0))::DOUBLE, 6) AS f1, coalesce(support, 0)::BIGINT AS support FROM t FULL JOIN q USING (run, label))"""
_LOG = """log AS (SELECT event_type AS run, day(ts)::INTEGER AS epoch, round(avg((value > 30)::INT), 6) AS train_acc, round(avg((value > 50)::INT), 6) AS val_acc, round(avg(value), 6) AS val_loss, round(max(value), 6) AS train_loss FROM events GROUP BY 1, 2)"""
_BEST = "b AS (SELECT *, greatest(coalesce(max(val_acc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS best_before, row_number() OVER (PARTITION BY run ORDER BY epoch) AS nth FROM log)"
_RUNS = "runs AS (SELECT concat_ws('_', series, run_no, file_id) AS run, best_val_acc, epochs_trained, file_id AS position, summary_json, run_id FROM training_summary)"
_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_ALL = "FROM e"


def _flat(expr: str, name: str) -> str:
    return f"WITH {_E}, a AS (SELECT vec_id, {expr} AS a FROM e) SELECT vec_id, (i - 1)::INTEGER AS pos, round(a[i], 6) AS {name} FROM (SELECT vec_id, a, unnest(range(1, len(a) + 1)) AS i FROM a)"


_LSM = "list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda y: exp(y - list_max(z))))))"
_LOSS = f"""l AS (SELECT vec_id, (label % 3)::INTEGER AS t, e[1:3] AS z FROM e), lp AS (SELECT *, {_LSM} AS lp FROM l),
  w AS (SELECT *, [1.5::DOUBLE, 1.0, 1.5] AS w FROM lp), ce AS (SELECT *, -lp[t + 1] AS plain, 0.9::DOUBLE * (-w[t + 1] * lp[t + 1]) + 0.1::DOUBLE * (-(w[1] * lp[1] + w[2] * lp[2] + w[3] * lp[3]) / 3) AS ce FROM w)"""
_LEAK = r"""keys AS (SELECT row_idx, split, 'hash' AS kind, md5_hash AS key FROM m WHERE split IS NOT NULL AND md5_hash IS NOT NULL UNION ALL SELECT row_idx, split, 'hash', sha256 FROM m WHERE split IS NOT NULL AND sha256 IS NOT NULL
  UNION ALL SELECT row_idx, split, 'filename', str_split(path, '/')[-1] FROM m WHERE split IS NOT NULL AND path IS NOT NULL UNION ALL SELECT row_idx, split, 'path', path FROM m WHERE split IS NOT NULL AND path IS NOT NULL)"""
_PAIRS = "seen AS (SELECT DISTINCT k.row_idx, k.kind, k.key, k.split, o.split AS other FROM {keys} k JOIN {keys} o ON o.kind = k.kind AND o.key = k.key AND o.row_idx < k.row_idx AND o.split <> k.split), pairs AS (SELECT concat_ws('|', least(split, other), greatest(split, other)) AS pair, count(*) AS n FROM seen WHERE kind = 'hash' GROUP BY 1)".replace("{keys}", "keys")
_COUNTS = """counts AS (SELECT CASE WHEN grouping_id(split, class_label, dataset_source) = 3 THEN 'split' WHEN grouping_id(split, class_label, dataset_source) = 5 THEN 'class' ELSE 'source' END AS kind,
  coalesce(split, class_label, dataset_source) AS name, count(*) AS n FROM {src} GROUP BY GROUPING SETS ((split), (class_label), (dataset_source)))"""
_SHARE = "shares AS (SELECT kind, name, n, n / (SELECT sum(n) FROM counts WHERE kind = 'split') AS share FROM counts), low AS (SELECT kind, name, n, round(share, 6) AS share FROM shares WHERE share < CASE kind WHEN 'source' THEN 0.01 ELSE 0.05 END)"
_FIELDS = ("path", "export_path", "split", "class_label", "dataset_source", "quality_score")
_OK = " AND ".join(f"coalesce(trim({c}::VARCHAR) <> '', false)" for c in _FIELDS)


def _issues(src: str, root: str | None) -> str:
    blank = lambda c: f"coalesce(trim({c}::VARCHAR) = '', true)"
    tests = {
        "Missing class_label": blank("class_label"),
        "Invalid split name": "NOT coalesce(split IN ('train', 'val', 'test'), false)",
        "Missing path or export_path": f"{blank('path')} OR {blank('export_path')}",
        "Invalid resolution": "width IS NULL OR height IS NULL",
        "Non-positive resolution": "width IS NOT NULL AND height IS NOT NULL AND (width <= 0 OR height <= 0)",
        **{f"Empty field: {c}": blank(c) for c in (*_FIELDS, "md5_hash", "sha256", "width", "height")},
    }
    if root:
        tests["Path escape"] = f"coalesce(NOT starts_with(export_path, '{root}/'), true)"
    return " UNION ALL ".join(f"SELECT row_idx, '{k}' AS issue FROM {src} WHERE {v}" for k, v in tests.items())


def _drift_sql() -> dict[str, str]:
    legs = "\n UNION ALL ".join(
        f"SELECT file_id, series, run_no, '{f}' AS field_name, '{p}' AS place, json_type(summary_json, '$.config.{p}') AS jt, json_extract(summary_json, '$.config.{p}') AS jv FROM good"
        for f, ps in _PLACES.items()
        for p in ps
    )
    base = f"""
      files AS (SELECT file_id, series, run_no, summary_json FROM training_summary),
      good AS (SELECT * FROM files WHERE json_valid(summary_json)),
      spots AS ({legs}),
      held AS (SELECT file_id, field_name, place, jv, CASE WHEN jt IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' ELSE lower(jt) END AS kind FROM spots WHERE jt IS NOT NULL AND jt <> 'NULL'),
      every AS (SELECT file_id, series, run_no, field_name FROM good, (SELECT DISTINCT field_name FROM spots)),
      lined AS (SELECT e.*, h.place, h.kind, h.jv FROM every e LEFT JOIN held h USING (file_id, field_name))
    """
    found = f"""WITH {base}, steps AS (
        SELECT file_id, field_name, place, kind, lag(place) OVER w AS p0, lag(kind) OVER w AS k0, row_number() OVER w AS nth FROM lined
        WINDOW w AS (PARTITION BY series, field_name ORDER BY run_no, file_id))
      SELECT file_id, field_name, 'added' AS change_kind FROM steps WHERE nth > 1 AND p0 IS NULL AND place IS NOT NULL
      UNION ALL SELECT file_id, field_name, 'removed' FROM steps WHERE nth > 1 AND p0 IS NOT NULL AND place IS NULL
      UNION ALL SELECT file_id, field_name, 'renamed' FROM steps WHERE nth > 1 AND p0 <> place
      UNION ALL SELECT file_id, field_name, 'retyped' FROM steps WHERE nth > 1 AND k0 <> kind"""
    text = "CASE WHEN kind = 'array' THEN array_to_string(from_json(jv, '[\"VARCHAR\"]'), '_') WHEN kind = 'varchar' THEN jv->>'$' ELSE jv::VARCHAR END"
    unified = f"""WITH {base}, vals AS (SELECT file_id, series, run_no, field_name, {text} AS v FROM lined)
      SELECT file_id, series, run_no,
        max(v) FILTER (field_name = 'attention_head') AS attention_head,
        bool_or(CASE WHEN lower(trim(v)) IN ('true', 'on', 'yes', '1') THEN true WHEN lower(trim(v)) IN ('false', 'off', 'no', '0') THEN false END) FILTER (field_name = 'use_fft') AS use_fft,
        max(v) FILTER (field_name = 'backbone') AS backbone
      FROM vals GROUP BY file_id, series, run_no"""
    return {"p7_found": found, "p7_unified": unified}


def _manifest_sql() -> dict[str, str]:
    m = _m()
    return {
        "flagship": f"""WITH {m.replace("m AS", "raw AS", 1)}, {_FLAGGED.replace("FROM m", "FROM raw")}, m AS (SELECT * FROM scored), {_EXACT}, good AS (SELECT * FROM exact WHERE quality_score >= 0.7), {_class_sample("good")}
            SELECT class_label, dataset_source, count(*) AS n, round(avg(quality_score), 6) AS avg_quality FROM picked GROUP BY 1, 2""",
        "index_manifest": """WITH d AS (SELECT coalesce(source, 'none') AS s, doc_id, text, (1 + (doc_id * 13) % 1024)::INTEGER AS width, (1 + (doc_id * 37) % 768)::INTEGER AS height FROM documents WHERE trim(text) <> '')
            SELECT s || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, s AS dataset_source, width, height, strlen(text)::BIGINT AS file_size_bytes, md5(text) AS md5_hash, sha256(text) AS sha256,
              round(width / height, 4) AS aspect_ratio, CASE s WHEN 'issue_tracker' THEN 'real' WHEN 'run_wiki' THEN 'ai_generated' ELSE 'unknown' END AS class_label FROM d""",
        "quality_flags": f"""WITH {m}, {_FLAGGED} SELECT row_idx, CASE WHEN len(flags) = 0 THEN 'ok' ELSE array_to_string(flags, '|') END AS flags, quality_score,
            coalesce(width >= 256 AND height >= 256, false) AS resolution_ok, coalesce(aspect_ratio BETWEEN 0.5 AND 2.0, false) AS aspect_ratio_ok FROM scored""",
        "quality_by_group": f"""WITH {m}, f AS (SELECT class_label, dataset_source, (len(quality_flag) > 0)::INT AS x FROM m), g AS (
            SELECT 'all' AS level, NULL AS name, count(*) AS total, coalesce(sum(x), 0) AS flagged FROM f UNION ALL SELECT 'class', class_label, count(*), coalesce(sum(x), 0) FROM f GROUP BY 2 UNION ALL SELECT 'source', dataset_source, count(*), coalesce(sum(x), 0) FROM f GROUP BY 2)
            SELECT level, name, total, flagged::BIGINT AS flagged, round(flagged * 100.0::DOUBLE / total, 6) AS pct FROM g""",
        "flag_frequency": f"""WITH {m}, known(flag) AS (VALUES ('corrupt'), ('low_resolution'), ('blurry'), ('aspect_ratio_extreme'), ('compressed'), ('opencv_read_failed')),
            c AS (SELECT flag, count(*) AS n FROM (SELECT unnest(quality_flag) AS flag FROM m) GROUP BY 1) SELECT flag, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM m), 6) AS pct FROM known FULL JOIN c USING (flag)""",
        "quality_filter_counts": f"WITH {m} SELECT count(*) FILTER (coalesce(quality_score, 0) >= 0.7) AS kept, count(*) FILTER (coalesce(quality_score, 0) < 0.7) AS skipped FROM m",
        "aspect_recomputed": f"WITH {m} SELECT row_idx, round(width / nullif(height, 0), 4) AS aspect_ratio FROM m",
        "path_parts": r"""WITH x AS (SELECT row_idx, path, str_split(path, '/') AS p FROM deduped_index), y AS (SELECT *, p[-1] AS name, lower(regexp_extract(p[-1], '\.([^.]*)$', 1)) AS ext, CASE WHEN starts_with(path, 'data_sources/') THEN substr(path, 14) ELSE path END AS relative FROM x)
            SELECT row_idx, name, p[-2] AS parent, regexp_replace(name, '\.[^.]*$', '') AS stem, ext, ext IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'webp') AS is_image, relative, regexp_replace('upscaled/' || relative, '\.[^./]*$', '.png') AS moved FROM y""",
        "keyword_filter": "SELECT row_idx, path FROM deduped_index WHERE lower(path) LIKE '%swap%' OR lower(path) LIKE '%inpaint%' OR lower(path) LIKE '%retouch%'",
        "ingest_filter": f"WITH {m} SELECT row_idx, width, height, format FROM m WHERE width >= 256 AND height >= 256 AND format IN ('JPEG', 'PNG') AND width::BIGINT * height <= 1000000",
        "complete_rows": f"WITH {_ME} SELECT count(*) FILTER ({_OK}) AS valid, count(*) FILTER (NOT ({_OK})) AS malformed FROM m",
    }


def _dedup_sql() -> dict[str, str]:
    m = _m()
    single = f"WITH RECURSIVE {m}, {_near('m')}, {_SINGLES}"
    return {
        "exact_dedup_kept": f"WITH {m}, {_EXACT} SELECT row_idx, path, md5_hash FROM exact",
        "exact_dedup_removed": f"WITH {m}, {_EXACT} SELECT row_idx, path, md5_hash FROM m WHERE row_idx NOT IN (SELECT row_idx FROM exact)",
        "dedup_conflicts": f"""WITH RECURSIVE {m}, {_EXACT}, {_near("exact")}, g AS (SELECT md5_hash FROM m WHERE md5_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT coalesce(class_label, '')) > 1),
            h AS (SELECT m.*, row_number() OVER (PARTITION BY md5_hash ORDER BY {_PREF}) AS rn FROM m WHERE md5_hash IN (SELECT md5_hash FROM g)),
            l AS (SELECT md5_hash, array_to_string(list_sort(list_distinct(list(path))), '|') AS conflict_paths, array_to_string(list_sort(list_distinct(list(class_label))), '|') AS conflict_labels FROM h GROUP BY 1)
            SELECT x.row_idx, 'exact' AS conflict_type, md5_hash AS conflict_hash, conflict_paths, conflict_labels, w.path AS winner_path, w.quality_score AS winner_quality_score, concat_ws('x', w.width, w.height) AS winner_resolution
            FROM h x JOIN l USING (md5_hash) JOIN h w USING (md5_hash) WHERE x.rn > 1 AND w.rn = 1
            UNION ALL SELECT x.row_idx, 'near', x.phash, array_to_string(list_sort(list_distinct(y.paths)), '|'), array_to_string(list_sort(list_distinct(y.labels)), '|'), y.w.path, y.w.quality_score, concat_ws('x', y.w.width, y.w.height)
            FROM clu x JOIN (SELECT cluster_key, list(path) AS paths, list(class_label) AS labels, first(struct_pack(row_idx, path, quality_score, width, height) ORDER BY {_PREF}) AS w FROM clu WHERE cluster_key IS NOT NULL
                             GROUP BY 1 HAVING count(DISTINCT coalesce(class_label, '')) > 1) y USING (cluster_key) WHERE x.row_idx <> y.w.row_idx""",
        "dedup_summary": f"""WITH RECURSIVE {m}, {_EXACT}, {_near("exact")}, kept AS (SELECT count(*) FILTER (cluster_key IS NULL) + count(DISTINCT cluster_key) AS n FROM clu),
            g AS (SELECT md5_hash, count(*) AS n FROM m WHERE md5_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT coalesce(class_label, '')) > 1)
            SELECT (SELECT count(*) FROM m) AS total, (SELECT n FROM kept) AS kept, (SELECT count(*) FROM m) - (SELECT count(*) FROM exact) AS exact_removed, (SELECT count(*) FROM exact) - (SELECT n FROM kept) AS near_removed, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM g) + (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM clu WHERE cluster_key IS NOT NULL GROUP BY cluster_key HAVING count(DISTINCT coalesce(class_label, '')) > 1)) AS cross_class""",
        "phash_vectors": """WITH v AS (SELECT vec_id, embedding AS e, list_sort(embedding) AS s FROM embeddings), t AS (SELECT vec_id, e, (s[32]::DOUBLE + s[33]::DOUBLE) / 2 AS m FROM v)
            SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda i: format('{:x}', 8 * (e[4 * i + 1] > m)::INT + 4 * (e[4 * i + 2] > m)::INT + 2 * (e[4 * i + 3] > m)::INT + (e[4 * i + 4] > m)::INT)), '') AS hash FROM t""",
        "hamming_pairs": """WITH h AS (SELECT row_idx, CASE WHEN regexp_full_match(lower(trim(phash)), '[0-9a-f]{16}') THEN ('0x' || lower(trim(phash)))::UBIGINT END AS v FROM deduped_index)
            SELECT a.row_idx, coalesce(bit_count(xor(a.v, b.v))::INTEGER, 999) AS distance FROM h a JOIN h b ON b.row_idx = a.row_idx + 1""",
        "near_dup_pairs": f"WITH RECURSIVE {m}, {_near('m')} SELECT bucket, h1, h2, distance FROM np",
        "near_dup_components": f"WITH RECURSIVE {m}, {_near('m')} SELECT row_idx, cluster_key FROM clu",
        "near_dup_kept": f"WITH RECURSIVE {m}, {_near('m')} SELECT row_idx FROM clu WHERE cluster_key IS NULL UNION ALL SELECT row_idx FROM (SELECT row_idx, row_number() OVER (PARTITION BY cluster_key ORDER BY {_PREF}) AS rn FROM clu WHERE cluster_key IS NOT NULL) WHERE rn = 1",
        "cluster_stats": f"""{single}, g AS (SELECT cluster_key, count(*) AS n, count(DISTINCT coalesce(class_label, '')) > 1 AS impure FROM single GROUP BY 1)
            SELECT count(*) AS clusters, trunc(quantile_cont(n, 0.5))::INTEGER AS p50, trunc(quantile_cont(n, 0.9))::INTEGER AS p90, trunc(quantile_cont(n, 0.99))::INTEGER AS p99, max(n) AS largest, count(*) FILTER (impure) AS impure, round(count(*) FILTER (impure) * 100.0::DOUBLE / count(*), 6) AS impure_pct FROM g""",
        "cluster_numbers": f"""{single}, g AS (SELECT cluster_key, row_number() OVER (ORDER BY min(path), cluster_key) - 1 AS k FROM single GROUP BY 1) SELECT row_idx, 'cluster_' || lpad(k::VARCHAR, 5, '0') AS cluster_id FROM single JOIN g USING (cluster_key)""",
    }


def _sample_sql() -> dict[str, str]:
    m = _m()
    frac = lambda seed, k: f"('0x' || substr(md5('{seed}|' || {k}), 1, 8))::UBIGINT / 4294967296::DOUBLE"
    return {
        "class_sample": f"WITH {m}, good AS (SELECT * FROM m WHERE coalesce(quality_score, 0) >= 0.7), {_class_sample('good')} SELECT row_idx, class_label, dataset_source FROM picked",
        "global_cap_sample": f"""WITH {m}, r AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY {_PREF}) AS k, count(*) OVER (PARTITION BY class_label) AS n, count(*) OVER () AS t FROM m),
            q AS (SELECT * FROM r WHERE t <= 500 OR k <= greatest(1, floor(500 * n / t))), a AS (SELECT row_idx, class_label, row_number() OVER (ORDER BY {_PREF}) AS g, t FROM q) SELECT row_idx, class_label FROM a WHERE t <= 500 OR g <= 500""",
        "label_quota_ingest": f"""WITH {m}, r AS (SELECT row_idx, class_label, row_number() OVER (PARTITION BY class_label ORDER BY row_idx) AS k FROM m WHERE width >= 256 AND height >= 256) SELECT row_idx, class_label FROM r WHERE k <= 100 ORDER BY row_idx LIMIT 250""",
        "limit_resume": "SELECT row_idx FROM deduped_index ORDER BY row_idx LIMIT 100",
        "even_sample": "WITH t AS (SELECT file_id, epochs_trained AS n FROM training_summary) SELECT file_id, unnest(CASE WHEN n <= 0 OR n IS NULL THEN [] WHEN 8 >= n THEN range(0, n) ELSE list_transform(range(0, 8), lambda i: i * n // 8) END)::INTEGER AS frame FROM t",
        "pair_list_explode": "SELECT n_name || '_' || n_regionkey AS name FROM nation UNION ALL SELECT n_regionkey || '_' || n_name FROM nation",
        "hash_split": f"WITH h AS (SELECT row_idx, {frac(42, 'path')} AS f FROM deduped_index) SELECT CASE WHEN f < 0.7::DOUBLE THEN 'train' WHEN f < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(row_idx)::BIGINT AS sum_idx FROM h GROUP BY 1",
        "sized_split": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('42|' || p_partkey), p_partkey) AS k, count(*) OVER () AS n FROM part) SELECT k <= ceil(n * 0.2::DOUBLE) AS held_out, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM r GROUP BY 1",
        "greedy_split_facts": f"""WITH RECURSIVE {_m(name="every")}, m AS (SELECT * FROM every WHERE trim(path) <> '' AND trim(class_label) <> '' AND trim(dataset_source) <> ''), {_near('m')}, {_SINGLES}
            SELECT count(*) AS images, count(DISTINCT cluster_key) AS clusters, 0::BIGINT AS divided, 3::BIGINT AS splits, 0::BIGINT AS far_splits, 0::BIGINT AS far_classes FROM single""",
        "split_report": f"""WITH {_MS}, b AS (SELECT split, count(DISTINCT cluster_id) AS clusters, count(*) AS images FROM m GROUP BY 1),
            c AS (SELECT split, array_to_string(list_sort(list(coalesce(class_label, '') || '=' || n)), '|') AS classes FROM (SELECT split, class_label, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
            s AS (SELECT split, array_to_string(list_sort(list(coalesce(dataset_source, '') || '=' || n)), '|') AS sources FROM (SELECT split, dataset_source, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1)
            SELECT b.split, clusters, images, classes, sources FROM b JOIN c ON b.split IS NOT DISTINCT FROM c.split JOIN s ON b.split IS NOT DISTINCT FROM s.split""",
        "leakage_check": f"WITH {_MS} SELECT cluster_id, count(DISTINCT split) AS splits FROM m WHERE cluster_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    }


def _export_sql() -> dict[str, str]:
    order = "class_label NULLS FIRST, dataset_source NULLS FIRST"
    return {
        "export_plan": rf"""WITH {_MS}, c AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {order}, quality_score DESC NULLS LAST, path, row_idx) AS k FROM m),
            d AS (SELECT *, coalesce(split, 'none') AS s, coalesce(class_label, 'unknown') AS cl, str_split(path, '/')[-1] AS name FROM c WHERE k <= 200), e AS (SELECT *, row_number() OVER (PARTITION BY s, cl, name ORDER BY path, row_idx) - 1 AS i FROM d)
            SELECT row_idx, split, 'export/' || s || '/' || cl || '/' || CASE WHEN i = 0 THEN name ELSE regexp_replace(name, '(\.[^.]*)?$', '') || '_' || i || regexp_extract(name, '(\.[^.]*)$', 1) END AS destination FROM e""",
        "export_cap_compat": f"""WITH {_MS}, q AS (SELECT * REPLACE (round(quality_score, 1) AS quality_score) FROM m), c AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {order}, quality_score::VARCHAR NULLS FIRST, path, row_idx) AS k FROM q) SELECT split, count(*) AS n, round(sum(quality_score), 6) AS quality FROM c WHERE k <= 200 GROUP BY 1""",
        "split_counts": f"WITH {_MS}, {_COUNTS.format(src='m')} SELECT * FROM counts",
        "copy_rates": f"""WITH {_MS}, j AS (SELECT split, path IN (SELECT path FROM export_index) AS x FROM m) SELECT split, count(*) AS planned, count(*) FILTER (x) AS copied, count(*) FILTER (NOT x) AS missed, round(count(*) FILTER (NOT x) * 100.0::DOUBLE / count(*), 6) AS miss_pct FROM j GROUP BY 1""",
        "copy_plan": """WITH f AS (SELECT DISTINCT path AS file FROM split_index), n AS (SELECT str_split(file, '/')[-1] AS name, min(file) AS file FROM f GROUP BY 1), r AS (SELECT DISTINCT path, str_split(path, '/')[-1] AS name FROM export_index)
            SELECT r.path, coalesce(f.file, n.file) AS source, 'out/' || r.name AS target FROM r LEFT JOIN f ON f.file = r.path LEFT JOIN n ON n.name = r.name""",
        "merge_manifests": f"""WITH {_m("export_index", _SPLIT, "a")}, {_m("split_index", _SPLIT, "b")}, u AS (SELECT 0 AS origin, row_idx, md5_hash, sha256 FROM a UNION ALL SELECT 1, row_idx, md5_hash, sha256 FROM b),
            r AS (SELECT *, row_number() OVER (PARTITION BY md5_hash, sha256 ORDER BY origin, row_idx) AS k FROM u) SELECT origin, row_idx FROM r WHERE k = 1 OR (md5_hash IS NULL AND sha256 IS NULL)""",
        "manifest_patch": rf"""WITH {_ME}, s AS (SELECT export_path AS old, regexp_replace('upscaled/' || CASE WHEN starts_with(export_path, 'exports/') THEN substr(export_path, 9) ELSE export_path END, '\.[^./]*$', '.png') AS new, coalesce(width, 0) * 4 AS w, coalesce(height, 0) * 4 AS h FROM m WHERE list_contains(quality_flag, 'low_resolution') AND export_path IS NOT NULL),
            c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY new, w, h) AS k FROM s) WHERE k = 1),
            j AS (SELECT row_idx, coalesce(c.new, export_path) AS export_path, coalesce(c.w, width)::INTEGER AS width, coalesce(c.h, height)::INTEGER AS height, CASE WHEN c.old IS NOT NULL THEN list_filter(quality_flag, lambda x: x <> 'low_resolution') ELSE quality_flag END AS f FROM m LEFT JOIN c ON c.old = m.export_path)
            SELECT row_idx, export_path, width, height, CASE WHEN len(f) > 0 THEN array_to_string(f, '|') ELSE 'ok' END AS flags FROM j""",
        "pending_outputs": "SELECT DISTINCT path FROM deduped_index WHERE path NOT IN (SELECT path FROM export_index WHERE path IS NOT NULL)",
    }


def _audit_sql() -> dict[str, str]:
    valid = f"v AS (SELECT * FROM m WHERE {_OK})"
    matrix = lambda c: f"WITH {_ME} SELECT {c}, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM m GROUP BY 1"
    picks = ", ".join(f"max(v) FILTER (r = least(n * {p} // 100, n - 1) + 1) AS p{p}" for p in (10, 25, 50, 75, 90, 99))
    leak_v = _LEAK.replace("FROM m ", "FROM v ")
    return {
        "split_class_matrix": matrix("class_label"),
        "split_source_matrix": matrix("dataset_source"),
        "imbalance_warnings": f"WITH {_ME}, {_COUNTS.format(src='m')}, {_SHARE} SELECT * FROM low",
        "hash_leakage": f"WITH {_ME}, {_LEAK}, g AS (SELECT kind, key, count(DISTINCT split) > 1 AS x FROM keys GROUP BY 1, 2) SELECT kind, count(*) FILTER (x) AS keys FROM g GROUP BY 1",
        "leakage_pairs": f"WITH {_ME}, {_LEAK}, {_PAIRS} SELECT * FROM pairs",
        "quality_stats": f"""WITH {_m()}, q AS (SELECT quality_score AS v, row_number() OVER (ORDER BY quality_score) AS r, count(*) OVER () AS n FROM m WHERE quality_score IS NOT NULL)
            SELECT count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, {picks}, count(*) FILTER (v < 0.7) AS below, round(count(*) FILTER (v < 0.7) * 100.0::DOUBLE / count(*), 6) AS below_pct FROM q""",
        "quality_histogram": f"""WITH {_m()}, b(bin, lo, hi) AS (VALUES (0, 0::DOUBLE, 0.5::DOUBLE), (1, 0.5, 0.7), (2, 0.7, 0.8), (3, 0.8, 0.9), (4, 0.9, 0.95), (5, 0.95, 1.0))
            SELECT bin, lo, hi, count(quality_score) AS n FROM b LEFT JOIN m ON quality_score >= lo AND (quality_score < hi OR (bin = 5 AND quality_score = hi)) GROUP BY 1, 2, 3""",
        "anomalies": f"WITH {_ME} {_issues('m', 'exports/v2')}",
        "audit_verdict": f"""WITH {_ME}, {valid}, {_COUNTS.format(src="v")}, {_SHARE}, {leak_v}, leaked AS (SELECT kind, key FROM keys GROUP BY 1, 2 HAVING count(DISTINCT split) > 1),
            f AS (SELECT (SELECT count(*) FROM m) AS rows, (SELECT count(*) FROM m) - (SELECT count(*) FROM v) AS malformed, (SELECT count(*) FROM v WHERE quality_score < 0.7) AS low_quality, (SELECT count(*) FROM leaked WHERE kind = 'hash') AS leaked, (SELECT count(*) FROM low) + (SELECT count(DISTINCT kind) FROM leaked) AS warnings,
              (SELECT count(*) FROM ({_issues("v", None)})) AS anomalies, (SELECT count(*) FROM (SELECT export_path FROM v GROUP BY 1 HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT path FROM v GROUP BY 1 HAVING count(*) > 1)) AS repeated)
            SELECT *, CASE WHEN rows - malformed = 0 OR malformed * 100.0 / rows > 1 OR leaked > 0 THEN 'FAIL' WHEN warnings + anomalies + malformed + repeated > 0 OR low_quality * 100.0 / (rows - malformed) > 10 THEN 'WARN' ELSE 'PASS' END AS verdict FROM f""",
        "duplicate_paths": "SELECT export_path, count(*) AS n FROM export_index WHERE export_path IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    }


def _evaluation_sql() -> dict[str, str]:
    total = lambda f: f"coalesce(sum(n) FILTER ({f}), 0)::BIGINT"
    wrong, between = "y_true <> y_pred", "y_true <> y_pred AND y_true IN (0, 2) AND y_pred IN (0, 2)"
    return {
        "confusion_matrix": f"WITH {_CUBE} SELECT run, y_true, {', '.join(f'{total(f"y_pred = {k}")} AS pred_{k}' for k in range(3))} FROM c GROUP BY 1, 2",
        "confusion_row_pct": f"WITH {_CUBE} SELECT run, y_true, y_pred, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY run, y_true), 6) AS pct FROM c",
        "class_report": f"WITH {_REPORT} SELECT * FROM rep",
        "accuracy_macro_f1": f"WITH {_REPORT}, f AS (SELECT run, round(avg(f1), 6) AS f1_macro FROM rep GROUP BY 1) SELECT run, round({total('y_true = y_pred')} / sum(n), 6) AS accuracy, f1_macro, sum(n)::BIGINT AS samples FROM c JOIN f USING (run) GROUP BY run, f1_macro",
        "boundary_errors": f"WITH {_CUBE} SELECT run, {total(between)} AS boundary, {total(wrong)} AS errors, round(coalesce({total(between)} / nullif({total(wrong)}, 0), 0), 6) AS share_of_errors, round({total(between)} / sum(n), 6) AS share_of_samples FROM c GROUP BY 1",
        "positional_pairs": f"WITH {_PRED} SELECT sample_id, y_true, y_pred FROM p",
        "present_labels": f"WITH {_PRED} SELECT y_true AS label FROM p UNION SELECT y_pred FROM p",
    }


def _epoch_sql() -> dict[str, str]:
    conf = lambda p: f"json_extract_string(j, '$.config.{p}')"
    return {
        "epoch_weighted_metrics": "WITH b AS (SELECT event_type AS run, day(ts)::INTEGER AS epoch, value AS loss, user_id % 5 AS correct, 5 + event_id % 3 AS n FROM events) SELECT run, epoch, round(sum(loss * n) / sum(n), 6) AS loss, round((sum(correct) / sum(n))::DOUBLE, 6) AS acc, sum(n)::BIGINT AS n FROM b GROUP BY 1, 2",
        "best_epoch": f"WITH {_LOG} SELECT run, epoch, val_acc FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_acc DESC, epoch) AS k FROM log) WHERE k = 1",
        "running_best": f"WITH {_LOG}, {_BEST} SELECT run, epoch, best_before, val_acc > best_before AS improved FROM b",
        "early_stop": f"""WITH {_LOG}, {_BEST}, s AS (SELECT *, nth - coalesce(max(CASE WHEN val_acc > best_before THEN nth END) OVER (PARTITION BY run ORDER BY epoch), 0) AS wait FROM b)
            SELECT run, coalesce(min(epoch) FILTER (wait >= 5), max(epoch)) AS stop_epoch, count(*) FILTER (wait >= 5) > 0 AS stopped FROM s GROUP BY 1""",
        "overfit_gap": f"WITH {_LOG} SELECT run, round(arg_max(train_acc - val_acc, epoch), 6) AS gap FROM log GROUP BY 1",
        "run_comparison": f"WITH {_LOG} SELECT run, max(val_acc) AS best_val_acc, CASE WHEN run <> 'click' THEN 12 ELSE count(*) END::BIGINT AS epochs_trained FROM log GROUP BY run",
        "run_filter": f"WITH {_LOG} SELECT run, epoch, val_acc FROM log WHERE run IN ('click', 'purchase', 'view') AND run <> 'view'",
        "curves": f"WITH {_LOG} SELECT run, epoch, metric, value FROM log UNPIVOT (value FOR metric IN (train_loss, val_loss, train_acc, val_acc))",
        "leaderboard": f"WITH {_RUNS}, r AS (SELECT run, row_number() OVER (ORDER BY coalesce(best_val_acc, 0) DESC, position) AS rank FROM runs) SELECT run, rank, CASE WHEN rank = 1 THEN '*' ELSE '' END || run AS shown FROM r",
        "top2_runs": f"WITH {_RUNS} SELECT run, best_val_acc FROM runs ORDER BY coalesce(best_val_acc, 0) DESC, run LIMIT 2",
        "palette": f"WITH {_RUNS} SELECT run, ((row_number() OVER (ORDER BY run) - 1) % 10)::INTEGER AS color FROM (SELECT DISTINCT run FROM runs)",
        "latest_run": rf"WITH {_RUNS} SELECT max(run_id) AS latest FROM runs WHERE regexp_full_match(run_id, 'run_\d{{8}}_\d{{6}}')",
        "run_dir_from_path": rf"""WITH {_RUNS} SELECT position, CASE position % 3 WHEN 0 THEN CASE WHEN run_id IS NOT NULL THEN coalesce(nullif(regexp_extract(run_id, '(run_\d{{8}}_\d{{6}})', 1), ''), nullif(run_id, ''), 'best') END WHEN 1 THEN run ELSE 'exp' END AS folder,
            strftime(try_strptime(nullif(regexp_extract(run_id, '^run_(\d{{8}}_\d{{6}})$', 1), ''), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS at FROM runs""",
        "summary_defaults": f"""WITH {_RUNS}, s AS (SELECT position, CASE WHEN json_valid(summary_json) THEN summary_json END AS j FROM runs)
            SELECT position, coalesce({conf("backbone")}, 'resnet18') AS backbone, coalesce(try_cast({conf("dropout_p")} AS DOUBLE), try_cast({conf("dropout")} AS DOUBLE), 0) AS dropout, coalesce({conf("lr_schedule")}, 'none') AS lr_schedule, coalesce({conf("augment")}, 'none') AS augment FROM s""",
        "arch_inference": """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'convnext_small' WHEN p_size > 25 THEN 'convnext_tiny' WHEN p_size > 10 AND p_partkey % 2 = 0 THEN 'resnet50' ELSE 'resnet18' END AS arch, p_partkey % 3 = 0 AS srm, false AS fft, p_size > 10 AND p_size <= 25 AS sequential_head FROM part""",
        "name_conflicts": """WITH t AS (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'gem' ELSE 'cbam' END AS named, CASE WHEN file_id % 5 = 0 THEN 'gem' END AS attention_head FROM training_summary)
            SELECT CASE named WHEN 'gem' THEN 'x__srm-gem' ELSE 'x__cbam' END AS run, file_id, attention_head, named FROM t WHERE coalesce(attention_head, 'none') <> named""",
        "lr_plateau": f"""WITH RECURSIVE {_LOG}, l AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS step, val_loss AS v FROM log),
            walk(run, step, best, bad, rate) AS (SELECT run, step, v, 0, 0.001::DOUBLE FROM l WHERE step = 0
              UNION ALL SELECT l.run, l.step, CASE WHEN v < best * (1 - 1e-4::DOUBLE) THEN v ELSE best END, CASE WHEN v < best * (1 - 1e-4::DOUBLE) OR bad + 1 > 2 THEN 0 ELSE bad + 1 END,
                CASE WHEN NOT v < best * (1 - 1e-4::DOUBLE) AND bad + 1 > 2 THEN rate * 0.5::DOUBLE ELSE rate END FROM walk JOIN l ON l.run = walk.run AND l.step = walk.step + 1)
            SELECT run, step::INTEGER AS step, rate FROM walk""",
        "lr_schedule": f"""WITH {_LOG}, c AS (SELECT run, epoch, epoch - 1 AS t, CASE WHEN epoch - 1 < 5 THEN 5 WHEN epoch - 1 < 15 THEN 10 ELSE 20 END AS len, CASE WHEN epoch - 1 < 5 THEN 0 WHEN epoch - 1 < 15 THEN 5 ELSE 15 END AS start FROM log)
            SELECT run, epoch, round(0.0005::DOUBLE * (1 + cos(pi() * (t - start) / len)), 9) AS rate FROM c""",
    }


def _kernel_sql() -> dict[str, str]:
    add = lambda a, b: f"list_transform(range(1, len({a}) + 1), lambda i: {a}[i] + {b}[i])"
    minmax = "list_transform({0}, lambda v: CASE WHEN list_max({0}) - list_min({0}) > 1e-8 THEN (v - list_min({0})) / (list_max({0}) - list_min({0})) ELSE 0 END)"
    cam = "list_transform(range(1, 17), lambda i: greatest(e[i] * list_avg(e[33:48]) + e[16 + i] * list_avg(e[49:64]), 0))"
    return {
        "softmax_argmax": f"""WITH {_E}, z AS (SELECT vec_id, e[1:3] AS z FROM e), x AS (SELECT vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM z)
            SELECT vec_id, (list_position(z, list_max(z)) - 1)::INTEGER AS top, round(list_max(x) / list_sum(x), 6) AS p_top, round(x[1] / list_sum(x), 6) AS p_0 FROM x""",
        "cross_entropy": f"WITH {_E}, {_LOSS} SELECT t, round(sum(ce) / sum(w[t + 1]), 6) AS loss, round(avg(plain), 6) AS plain FROM ce GROUP BY t",
        "focal_loss": f"WITH {_E}, {_LOSS} SELECT vec_id, round(pow(1 - exp(-ce), 3) * ce, 6) AS loss FROM ce",
        "gem_pool": f"WITH {_E} SELECT vec_id, round(pow(list_avg(list_transform(e, lambda v: pow(greatest(v, 1e-6), 3))), 1.0 / 3), 6) AS gem FROM e",
        "channel_concat_pad": _flat("list_concat(e, list_transform(range(0, 32), lambda i: 0::DOUBLE))", "value"),
        "cam_from_arrays": f"WITH {_E}, c AS (SELECT vec_id, {cam} AS c FROM e), a AS (SELECT vec_id, {minmax.format('c')} AS a FROM c) SELECT vec_id, (i - 1)::INTEGER AS pos, round(a[i], 6) AS cam FROM (SELECT vec_id, a, unnest(range(1, 17)) AS i FROM a)",
        "overlay_blend": _flat("list_transform(range(1, 33), lambda i: 0.6::DOUBLE * e[i] + 0.4::DOUBLE * e[32 + i])", "value"),
        "normalize_vector": _flat("list_transform(range(1, 65), lambda i: (e[i] / 255 - [0.485::DOUBLE, 0.456, 0.406][(i - 1) % 3 + 1]) / [0.229::DOUBLE, 0.224, 0.225][(i - 1) % 3 + 1])", "value"),
        "minmax_group": _flat(minmax.format("e"), "value"),
        "flip_and_brighten": _flat("list_transform(list_transform(range(0, 64), lambda i: e[(i // 8) * 8 + 8 - i % 8]), lambda v: least(255, greatest(0, v * 100 + 20)))", "value"),
        "brightness_predictor": f"""WITH {_E}, m AS (SELECT vec_id, least(1, greatest(0, 0.2::DOUBLE + 0.6::DOUBLE * (list_sum(list_transform(e, lambda v: abs(v))) * 4) / 255)) AS r FROM e), a AS (SELECT vec_id, [r, 0.6::DOUBLE * (1 - r), 0.4::DOUBLE * (1 - r)] AS a FROM m)
            SELECT vec_id, (i - 1)::INTEGER AS pos, round(a[i] / list_sum(a), 6) AS p FROM (SELECT vec_id, a, unnest(range(1, 4)) AS i FROM a)""",
        "srm_row": _flat("list_transform(range(1, 65), lambda i: -0.5::DOUBLE * CASE WHEN i > 1 THEN e[i - 1] ELSE 0 END + e[i] - 0.5::DOUBLE * CASE WHEN i < 64 THEN e[i + 1] ELSE 0 END)", "residual"),
        "srm_residual": f"""WITH {_E}, k AS (SELECT kn, dy, dx, w FROM (VALUES (0, [0, 0, -1, 0, 0, 0, -1, -2, -1, 0, -1, -2, 16, -2, -1, 0, -1, -2, -1, 0, 0, 0, -1, 0, 0], 8), (1, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -1, 2, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 2), (2, [0, 0, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 2, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 0, 0], 2)) v(kn, ws, d),
              LATERAL (SELECT i // 5 - 2 AS dy, i % 5 - 2 AS dx, ws[i + 1] / d AS w FROM range(0, 25) r(i)) WHERE w <> 0),
            p AS (SELECT vec_id, e, y, x FROM e, range(0, 8) a(y), range(0, 8) b(x))
            SELECT vec_id, (kn * 64 + y * 8 + x)::INTEGER AS pos, round(least(2, greatest(-2, sum(w * CASE WHEN y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 THEN e[(y + dy) * 8 + x + dx + 1] ELSE 0 END))), 6) AS residual FROM p, k GROUP BY vec_id, kn, y, x""",
        "fft_magnitude": f"""WITH {_E}, v AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, e[i + 1] AS z FROM e, range(0, 64) r(i)), f AS (SELECT i // 8 AS fy, i % 8 AS fx FROM range(0, 64) r(i)),
            s AS (SELECT vec_id, fy, fx, sum(z * cos(2 * pi() * (fy * y + fx * x) / 8)) AS re, sum(z * sin(2 * pi() * (fy * y + fx * x) / 8)) AS im FROM v, f GROUP BY ALL),
            l AS (SELECT vec_id, (fy + 4) % 8 * 8 + (fx + 4) % 8 AS pos, ln(sqrt(re * re + im * im) + 1e-8) AS m FROM s)
            SELECT vec_id, pos::INTEGER AS pos, round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w + 1e-8), 6) AS magnitude FROM l WINDOW w AS (PARTITION BY vec_id)""",
        "blur_score": f"""WITH {_E}, v AS (SELECT vec_id, e, i // 8 AS y, i % 8 AS x FROM e, range(0, 64) r(i)),
            l AS (SELECT vec_id, e[abs(y - 1) * 8 + x + 1] + e[(7 - abs(6 - y)) * 8 + x + 1] + e[y * 8 + abs(x - 1) + 1] + e[y * 8 + (7 - abs(6 - x)) + 1] - 4 * e[y * 8 + x + 1] AS z FROM v)
            SELECT vec_id, round(var_pop(z), 6) AS blur FROM l GROUP BY 1""",
    }


def _joined_sql() -> dict[str, str]:
    """Merges of folders, round trips through files, tables of runs, and images of several planes."""
    log_names = "CASE vec_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' WHEN 2 THEN 'view' ELSE 'other' END"
    f1s = lambda names: ", ".join(f"max(f1) FILTER (label = {k}) AS f1_{n}" for k, n in enumerate(names))
    report = _REPORT.replace("'run_' || (vec_id % 4)", log_names, 1)
    kernels = """k AS (SELECT kn, dy, dx, w FROM (VALUES (0, [0, 0, -1, 0, 0, 0, -1, -2, -1, 0, -1, -2, 16, -2, -1, 0, -1, -2, -1, 0, 0, 0, -1, 0, 0], 8), (1, [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -1, 2, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], 2), (2, [0, 0, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 2, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 0, 0], 2)) v(kn, ws, d),
              LATERAL (SELECT i // 5 - 2 AS dy, i % 5 - 2 AS dx, ws[i + 1] / d AS w FROM range(0, 25) r(i)) WHERE w <> 0)"""
    mlp = lambda v: f"[greatest(0, 0.5::DOUBLE * {v}[1] - 0.25::DOUBLE * {v}[2] + 0.75::DOUBLE * {v}[3] + 0.1::DOUBLE * {v}[4]), greatest(0, 0.2::DOUBLE * {v}[1] + 0.3::DOUBLE * {v}[2] - 0.4::DOUBLE * {v}[3] + 0.6::DOUBLE * {v}[4])]"
    cam = "list_transform(range(1, 17), lambda i: greatest(e[i] * list_avg(e[33:48]) + e[16 + i] * list_avg(e[49:64]), 0))"
    jet = lambda at: f"least(1::DOUBLE, greatest(0::DOUBLE, 1.5::DOUBLE - abs(4 * heat - {at}))) * 255"
    side = lambda t, f, k: f"SELECT {f} AS folder, '{k}' AS kind, row_idx, md5_hash, sha256 FROM {t}"
    return {
        "merge_many": f"""WITH {_m("sampled_index", name="a")}, {_m("export_index", name="b")}, {_m("deduped_index", name="c")}, {_m("split_index", name="x")},
            u AS ({side("a", 0, "sampled")} UNION ALL {side("b", 0, "export")} UNION ALL {side("c", 1, "sampled")} UNION ALL {side("x", 1, "export")}),
            r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(md5_hash, ''), coalesce(sha256, '') ORDER BY folder, kind DESC, row_idx) AS k FROM u) SELECT kind, folder, row_idx FROM r WHERE k = 1 OR (md5_hash IS NULL AND sha256 IS NULL)""",
        "dry_run_preview": _export_sql()["copy_plan"] + " ORDER BY r.path LIMIT 5",
        "pair_list_head": "SELECT name FROM (SELECT n_name || '_' || n_regionkey AS name FROM nation UNION ALL SELECT n_regionkey || '_' || n_name FROM nation) ORDER BY name LIMIT 20",
        "accuracy_bars": f"WITH {_CUBE}, a AS (SELECT run, round(sum(n) FILTER (y_true = y_pred) / sum(n), 6) AS accuracy FROM c GROUP BY 1) SELECT run, accuracy, row_number() OVER (ORDER BY accuracy, run) - 1 AS position FROM a",
        "manifest_round_trip": f"""WITH {_m(extra=", resolution_ok")} SELECT row_idx, path, dataset_source, class_label, width, height, aspect_ratio, file_size_bytes, md5_hash, quality_score, phash, blur_score, resolution_ok,
            CASE WHEN len(quality_flag) > 0 THEN array_to_string(quality_flag, '|') ELSE 'ok' END AS flags FROM m""",
        "predictions_round_trip": f"WITH {_PRED} SELECT run, row_number() OVER (PARTITION BY run ORDER BY sample_id) - 1 AS sample_id, y_true, y_pred, count(*) OVER (PARTITION BY run) AS samples FROM p",
        "epoch_logs_round_trip": f"WITH {_LOG} SELECT run, epoch, train_loss, val_acc FROM log",
        "run_table": f"""WITH {_LOG}, {report}, s AS (SELECT run, round(avg(f1), 6) AS f1_macro, {f1s(range(3))} FROM rep GROUP BY 1), acc AS (SELECT run, round(sum(n) FILTER (y_true = y_pred) / sum(n), 6) AS accuracy FROM c GROUP BY 1),
            b AS (SELECT run, max(val_acc) AS best_val_acc, CASE WHEN run <> 'click' THEN 12 ELSE count(*) END::BIGINT AS epochs_trained, round(arg_max(train_acc - val_acc, epoch), 6) AS gap FROM log GROUP BY run)
            SELECT b.*, accuracy, f1_macro, f1_0, f1_1, f1_2, row_number() OVER (ORDER BY coalesce(best_val_acc, 0) DESC, run) AS rank FROM b LEFT JOIN s USING (run) LEFT JOIN acc USING (run)""",
        "sweep_ranking": f"""WITH {_REPORT}, s AS (SELECT run, round(avg(f1), 6) AS f1_macro, {f1s(("real", "ai_gen", "ai_edit"))} FROM rep GROUP BY 1),
            o AS (SELECT 'run_' || n_nationkey AS run, '[' || n_regionkey || '.5,1.0,2.5]' AS weights, CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey % 7) / 10 END AS best_val_acc, n_nationkey AS position FROM nation),
            r AS (SELECT *, row_number() OVER (ORDER BY coalesce(best_val_acc, 0) DESC, position) AS rank FROM o LEFT JOIN s USING (run))
            SELECT rank, CASE WHEN rank = 1 THEN '*' ELSE '' END || run AS shown, weights, best_val_acc, f1_macro, f1_real, f1_ai_gen, f1_ai_edit FROM r""",
        "srm_six_channels": f"""WITH {_E}, rgb AS (SELECT vec_id, list_concat(e, list_reverse(e), list_transform(e, lambda v: v * 0.5::DOUBLE)) AS a FROM e), g AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (a[i] + a[64 + i] + a[128 + i]) / 3) AS e FROM rgb), {kernels},
            p AS (SELECT vec_id, e, y, x FROM g, range(0, 8) a(y), range(0, 8) b(x))
            SELECT vec_id, (i - 1)::INTEGER AS pos, round(a[i], 6) AS value FROM (SELECT vec_id, a, unnest(range(1, 193)) AS i FROM rgb) UNION ALL
            SELECT vec_id, (192 + kn * 64 + y * 8 + x)::INTEGER, round(least(2, greatest(-2, sum(w * CASE WHEN y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 THEN e[(y + dy) * 8 + x + dx + 1] ELSE 0 END))), 6) FROM p, k GROUP BY vec_id, kn, y, x""",
        "channel_attention": f"""WITH {_E}, s AS (SELECT vec_id, e, list_transform(range(0, 4), lambda c: list_avg(e[c * 16 + 1 : c * 16 + 16])) AS m, list_transform(range(0, 4), lambda c: list_max(e[c * 16 + 1 : c * 16 + 16])) AS x FROM e),
            h AS (SELECT vec_id, e, {mlp("m")} AS hm, {mlp("x")} AS hx FROM s), w AS (SELECT *, [[0.3::DOUBLE, 0.7], [0.5, -0.2], [-0.6, 0.4], [0.1, 0.9]] AS w2 FROM h)
            SELECT vec_id, (i - 1)::INTEGER AS pos, round(e[i] / (1 + exp(-(w2[(i - 1) // 16 + 1][1] * (hm[1] + hx[1]) + w2[(i - 1) // 16 + 1][2] * (hm[2] + hx[2])))), 6) AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM w)""",
        "cam_overlay": f"""WITH {_E}, c AS (SELECT vec_id, e, (list_position(e, list_max(e)) - 1)::INTEGER AS top, {cam} AS c FROM e),
            m AS (SELECT vec_id, e, top, list_transform(c, lambda v: CASE WHEN list_max(c) - list_min(c) > 1e-8 THEN (v - list_min(c)) / (list_max(c) - list_min(c)) ELSE 0 END) AS c FROM c),
            spots AS (SELECT i, least(3::DOUBLE, greatest(0::DOUBLE, (i // 8 + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE)) AS y, least(3::DOUBLE, greatest(0::DOUBLE, (i % 8 + 0.5::DOUBLE) * 0.5::DOUBLE - 0.5::DOUBLE)) AS x FROM range(0, 64) r(i)),
            w AS (SELECT i, floor(y)::INTEGER AS y0, least(3, floor(y)::INTEGER + 1) AS y1, y - floor(y) AS fy, floor(x)::INTEGER AS x0, least(3, floor(x)::INTEGER + 1) AS x1, x - floor(x) AS fx FROM spots),
            h AS (SELECT vec_id, top, i, e[i + 1] AS v, (c[y0 * 4 + x0 + 1] * (1 - fx) + c[y0 * 4 + x1 + 1] * fx) * (1 - fy) + (c[y1 * 4 + x0 + 1] * (1 - fx) + c[y1 * 4 + x1 + 1] * fx) * fy AS heat FROM m, w)
            SELECT vec_id, top, (3 * i)::INTEGER AS pos, round(0.5::DOUBLE * abs(v) * 100 + 0.5::DOUBLE * {jet(3)}, 4) AS value FROM h UNION ALL SELECT vec_id, top, (3 * i + 1)::INTEGER, round(0.5::DOUBLE * abs(v) * 50 + 0.5::DOUBLE * {jet(2)}, 4) FROM h
            UNION ALL SELECT vec_id, top, (3 * i + 2)::INTEGER, round(10::DOUBLE + 0.5::DOUBLE * {jet(1)}, 4) FROM h""",
    }


def oracle_sql() -> dict[str, str]:
    return _manifest_sql() | _dedup_sql() | _sample_sql() | _export_sql() | _audit_sql() | _evaluation_sql() | _epoch_sql() | _kernel_sql() | _drift_sql() | _joined_sql()
