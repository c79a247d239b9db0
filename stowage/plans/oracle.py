"""DuckDB SQL for the queries of ``queries.py``; views stand for the derived catalog."""

from __future__ import annotations

from .fixture import NOW

#: Common table expressions by name, in order of dependence; a query gets those it needs.
VIEWS: dict[str, str] = {
    "src": """SELECT d.doc_id AS d, d.lang, d.source AS root_id, sha256(d.text) AS h, CAST(octet_length(encode(d.text)) AS BIGINT) AS size,
        CAST(substr(d.source, 4) AS INT) AS s, d.doc_id // 160 AS g, (d.doc_id // 20) % 8 AS slot, l.toxic, l.quality
        FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""",
    "named": """SELECT *, (['shelf','ollama','hf_hub','removable'])[s % 4 + 1] AS kind,
        (['m-00001-of-00003.gguf','m-00002-of-00003.gguf','m-00003-of-00003.gguf','mmproj-F16.gguf','other-Q4.gguf','emb/model.safetensors','emb/sub/config.json','notes-Q8.gguf'])[slot + 1] AS fname FROM src""",
    "files": """SELECT root_id, d AS ord, kind,
        CASE kind WHEN 'ollama' THEN 'blobs/sha256-' || substr(h, 1, 12) WHEN 'hf_hub' THEN 'models--org--' || lang || '/snapshots/r' || g || '/' || fname ELSE lang || '/g' || g || '/' || fname END AS rel_path,
        size, d % 49 <> 0 AS has_fp, CAST(s % 3 AS BIGINT) AS dev, d + 1 AS ino, CASE WHEN d % 7 <> 0 THEN h END AS sha256,
        CASE kind WHEN 'ollama' THEN 'fam' || g || ':' || lang || CASE WHEN slot = 3 THEN '+projector' ELSE '' END WHEN 'hf_hub' THEN 'org/' || lang END AS name,
        d % 4 <> 3 AND slot NOT IN (3, 6) AS has_meta, (['llama','qwen','bert'])[d % 3 + 1] AS arch, CASE WHEN d % 2 = 0 THEN (['7B','13B'])[(d // 2) % 2 + 1] END AS label,
        CASE WHEN d % 5 = 0 THEN 'Q4_K_M' END AS quant, coalesce(toxic, 0) <> 1 AS readable, CASE WHEN quality = 1 THEN 1700000000 + d * 10000 END AS verified_unix FROM named""",
    "roots": """SELECT DISTINCT root_id, kind, s % 5 <> 0 AS online, CASE WHEN s % 2 = 0 THEN 'disk ' || root_id END AS label FROM named""",
    "keyed": """SELECT *, CASE WHEN sha256 IS NOT NULL THEN 'sha256:' || sha256 WHEN has_fp THEN 'pending:' || dev || ':' || ino || ':' || size ELSE 'unknown:' || root_id || ':' || rel_path END AS key,
        split_part(rel_path, '/', -1) AS file, coalesce(name, regexp_replace(split_part(rel_path, '/', -1), '^(.+)\\.[^.]*$', '\\1')) AS shown FROM files""",
    "models": """SELECT key, arg_min(size, (root_id, ord)) AS size, arg_min(shown, (root_id, ord)) AS display_name, arg_min(arch, (root_id, ord)) FILTER (has_meta) AS architecture,
        arg_min({'v': label}, (root_id, ord)) FILTER (has_meta) AS l, arg_min({'v': quant}, (root_id, ord)) FILTER (has_meta) AS q FROM keyed GROUP BY key""",
    "stated": """SELECT k.key, k.root_id, k.kind, k.rel_path, k.file, k.ord, k.readable AND r.online AS accessible, CASE WHEN has_fp THEN dev ELSE 0 END AS dev, CASE WHEN has_fp THEN ino ELSE 0 END AS ino,
        CASE WHEN NOT r.online THEN 'Offline' WHEN k.readable THEN 'Present' ELSE 'Unreadable' END AS state,
        regexp_matches(file, '(?i)\\.(safetensors|bin|pt|pth|onnx)$') AS weights, lower(file) LIKE '%mmproj%' AS projector,
        regexp_extract(file, '^(.*)-(\\d{5})-of-(\\d{5})\\.gguf$', 1) AS prefix, TRY_CAST(regexp_extract(file, '^(.*)-(\\d{5})-of-(\\d{5})\\.gguf$', 2) AS INT) AS part, TRY_CAST(regexp_extract(file, '^(.*)-(\\d{5})-of-(\\d{5})\\.gguf$', 3) AS INT) AS parts,
        CASE WHEN k.kind = 'hf_hub' THEN array_to_string(string_split(rel_path, '/')[1:3], '/') ELSE array_to_string(string_split(rel_path, '/')[:-2], '/') END AS box
        FROM keyed k JOIN roots r USING (root_id)""",
    "bundle": """SELECT key, key AS member FROM models
        UNION SELECT a.key, b.key FROM stated a JOIN models ma ON a.key = ma.key JOIN stated b ON a.root_id = b.root_id AND b.kind = 'ollama' JOIN models mb ON b.key = mb.key
          WHERE a.kind = 'ollama' AND replace(ma.display_name, '+projector', '') = replace(mb.display_name, '+projector', '')
        UNION SELECT a.key, b.key FROM stated a JOIN stated b ON a.root_id = b.root_id WHERE a.kind <> 'ollama' AND b.kind <> 'ollama' AND a.weights AND a.box <> '' AND starts_with(b.rel_path, a.box || '/')
        UNION SELECT a.key, b.key FROM stated a JOIN stated b ON a.root_id = b.root_id AND a.box = b.box WHERE a.kind <> 'ollama' AND b.kind <> 'ollama' AND NOT (a.weights AND a.box <> '')
          AND ((a.part IS NOT NULL AND b.part IS NOT NULL AND a.prefix = b.prefix AND a.parts = b.parts) OR (b.projector AND NOT a.projector))""",
    "companions": """SELECT b.member AS companion, b.key AS required_by FROM bundle b WHERE b.key <> b.member AND NOT EXISTS (SELECT 1 FROM bundle r WHERE r.key = b.member AND r.member = b.key)""",
    "firsts": """SELECT key, arg_min(part, (root_id, ord)) AS raw, arg_min(file, (root_id, ord)) AS file FROM stated GROUP BY key""",
    "parts_of": """SELECT key, TRY_CAST(regexp_extract(file, '^(.*)-(\\d{5})-of-(\\d{5})\\.gguf$', 2) AS INT) AS part FROM firsts""",
    "split_primary": """SELECT b.key AS part, min(b.member) AS "primary" FROM bundle b JOIN parts_of p ON p.key = b.key AND p.part <> 1 JOIN parts_of o ON o.key = b.member AND o.part = 1 GROUP BY b.key""",
    "children": """SELECT coalesce(c.child, s.part) AS child, coalesce(c.of, s."primary") AS parent FROM (SELECT companion AS child, min(required_by) AS of FROM companions GROUP BY companion) c FULL JOIN split_primary s ON c.child = s.part""",
    "selected": """SELECT DISTINCT key FROM stated WHERE root_id IN ('src2', 'src3', 'src4') AND key LIKE 'sha256:%'""",
    "chosen": """SELECT DISTINCT member AS key FROM bundle WHERE key IN (SELECT key FROM selected)""",
    "deletable": """SELECT c.key, CASE WHEN n.key IS NULL THEN 'delete' ELSE 'keep' END AS action, n.kept_for FROM chosen c LEFT JOIN
        (SELECT b.member AS key, arg_min(m.display_name, b.key) AS kept_for FROM bundle b JOIN models m ON m.key = b.key WHERE b.key NOT IN (SELECT key FROM chosen) GROUP BY b.member) n USING (key)""",
    "backed": """SELECT key, bool_or(kind = 'removable' AND state <> 'Unreadable') AS backed_up FROM stated GROUP BY key""",
    "dups": """SELECT m.key, m.size, m.display_name, x.extra_copies, CAST(m.size * x.extra_copies AS BIGINT) AS reclaimable FROM models m JOIN
        (SELECT key, CAST(sum(n - 1) AS BIGINT) AS extra_copies FROM (SELECT key, dev, count(DISTINCT ino) AS n FROM stated WHERE state = 'Present' AND dev <> 0 AND key LIKE 'sha256:%' GROUP BY key, dev) GROUP BY key HAVING sum(n - 1) > 0) x USING (key)""",
    "first_live": """SELECT key, arg_min({'r': root_id, 'k': kind, 'p': rel_path}, (root_id, ord)) AS s FROM stated WHERE state = 'Present' GROUP BY key""",
    "dest": """SELECT m.key, m.size, f.s.r AS r, f.s.p AS p, CASE f.s.k WHEN 'ollama' THEN translate(m.display_name, ':/', '--') || '/' || translate(m.display_name, ':/', '--') || '.gguf'
        WHEN 'hf_hub' THEN split_part(m.display_name, '/', -1) || '/' || CASE WHEN len(string_split(f.s.p, '/')) > 3 THEN array_to_string(string_split(f.s.p, '/')[4:], '/') ELSE 'model.gguf' END ELSE f.s.p END AS dest FROM models m LEFT JOIN first_live f USING (key)""",
    "backup": """SELECT d.*, CASE WHEN d.key NOT LIKE 'sha256:%' THEN 'not hashed' WHEN d.key IN (SELECT key FROM stated WHERE root_id = 'src3') THEN 'skipped_already' WHEN d.r IS NULL THEN 'no reachable copy' ELSE 'copy' END AS status FROM dest d""",
    "command_of": """SELECT k.key, k.root_id, k.rel_path, k.ord, CASE k.kind WHEN 'ollama' THEN 'ollama rm ' || replace(m.display_name, '+projector', '')
        WHEN 'hf_hub' THEN 'hf cache rm model/' || replace(substr(split_part(k.rel_path, '/', 1), 9), '--', '/') || ' -y' END AS command FROM stated k JOIN models m USING (key)""",
    "delete_plan": """SELECT s.key, s.root_id, s.rel_path, CASE WHEN s.kind NOT IN ('shelf', 'removable') THEN 'foreign' WHEN s.state <> 'Present' THEN 'offline' ELSE 'trash' END AS action,
        CASE WHEN s.kind NOT IN ('shelf', 'removable') THEN c.command WHEN s.state <> 'Present' THEN coalesce(r.label, r.root_id) END AS detail
        FROM deletable d JOIN stated s ON d.key = s.key AND d.action = 'delete' JOIN roots r ON r.root_id = s.root_id JOIN command_of c ON c.key = s.key AND c.root_id = s.root_id AND c.ord = s.ord
        UNION ALL SELECT key, '', '', 'keep', kept_for FROM deletable WHERE action = 'keep'""",
    "fresh": """SELECT root_id, ord, CASE WHEN ord % 17 = 0 THEN 'aside/' || rel_path ELSE rel_path END AS rel_path, CASE WHEN ord % 13 = 0 THEN NULL WHEN ord % 11 = 0 THEN reverse(sha256) ELSE sha256 END AS fresh_sha FROM files""",
    "verify": """SELECT f.root_id, f.rel_path, f.sha256, CASE WHEN f.sha256 IS NULL THEN 'unhashed' WHEN n.ord IS NULL THEN 'missing' WHEN n.fresh_sha IS NULL THEN 'unreadable' WHEN n.fresh_sha = f.sha256 THEN 'ok' ELSE 'mismatched' END AS status, f.size
        FROM files f JOIN roots r ON r.root_id = f.root_id AND r.online AND r.kind IN ('shelf', 'removable') LEFT JOIN fresh n ON n.root_id = f.root_id AND n.rel_path = f.rel_path""",
    "inodes": """SELECT key, dev, ino, count(*) AS paths, bool_or(kind IN ('shelf', 'removable')) AS any_owned, bool_and(kind IN ('shelf', 'removable')) AS all_owned FROM stated WHERE state = 'Present' AND dev <> 0 AND key LIKE 'sha256:%' GROUP BY ALL""",
    "earlier": """SELECT * REPLACE (CASE WHEN ord % 5 = 0 THEN 'aside/' || rel_path ELSE rel_path END AS rel_path) FROM files""",
    "listing": """SELECT rel_path AS filename, min(ord) AS ord, CASE WHEN min(ord) % 10 <> 3 THEN arg_min(size, ord) END AS size FROM files WHERE kind IN ('shelf', 'removable') GROUP BY rel_path""",
    "bin": """SELECT DISTINCT root_id, rel_path, split_part(rel_path, '/', -1) AS f, array_to_string(string_split(rel_path, '/')[:-2], '/') AS d,
        regexp_matches(rel_path, '(?i)\\.(safetensors|bin|pt|pth|onnx)$') AS w, lower(split_part(rel_path, '/', -1)) LIKE '%mmproj%' AS p,
        CASE WHEN regexp_matches(rel_path, '-\\d{5}-of-\\d{5}\\.gguf$') THEN regexp_replace(split_part(rel_path, '/', -1), '-\\d{5}-of-', '|') END AS set_name FROM files WHERE kind IN ('shelf', 'removable')""",
    "on_disk": """SELECT f.root_id, f.rel_path, f.size, s.h FROM (SELECT root_id, rel_path, arg_min(size, ord) AS size, min(ord) AS ord FROM files WHERE kind IN ('shelf', 'removable') GROUP BY root_id, rel_path) f JOIN src s ON s.d = f.ord""",
    "asked": """SELECT b.*, d <> '' AND NOT p AND EXISTS (SELECT 1 FROM bin x WHERE x.root_id = b.root_id AND x.w AND starts_with(x.rel_path, b.d || '/')) AS whole FROM bin b
        WHERE lower(rel_path) LIKE '%m%0000%' OR lower(rel_path) LIKE '%emb/%' OR lower(rel_path) LIKE '%q8%'""",
    "big": """SELECT 'sha256:' || l_partkey AS key, 'sup' || l_suppkey AS root_id, (['shelf','ollama','hf_hub','removable'])[l_suppkey % 4 + 1] AS kind, l_suppkey % 7 AS dev, l_orderkey * 8 + l_linenumber AS ino FROM lineitem WHERE l_suppkey % 5 <> 0""",
    "parts_big": """SELECT 'sha256:' || p_partkey AS key, CAST(p_size AS BIGINT) AS size, p_name AS display_name, p_brand || ' ' || p_type AS family FROM part""",
    "reach": """SELECT key, bool_or(state = 'Present' AND kind IN ('shelf', 'removable')) AS owned_copy, bool_or(state = 'Present') AS live, bool_or(state = 'Present' AND kind = 'shelf') AS on_shelf,
        bool_or(state = 'Present' AND kind = 'removable') AS on_drive, bool_or(state = 'Offline' AND kind = 'removable') AS unplugged FROM stated GROUP BY key""",
    "place_names": """SELECT key, array_to_string(list_sort(list(DISTINCT CASE kind WHEN 'hf_hub' THEN 'hf-hub' WHEN 'removable' THEN 'drive' ELSE kind END)), ' + ') AS places, bool_and(kind = 'removable') AS cold FROM stated GROUP BY key""",
    "tops": """SELECT m.key, p.cold, contains(lower(concat_ws(' ', m.display_name, coalesce(m.q.v, ''), p.places, m.key)), 'gguf') AS hit FROM models m JOIN place_names p USING (key)""",
    "stale": f"""SELECT root_id, min(coalesce(verified_unix, 0)) AS oldest, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE kind = 'removable' AND sha256 IS NOT NULL GROUP BY root_id
        HAVING min(coalesce(verified_unix, 0)) = 0 OR ({NOW} - min(coalesce(verified_unix, 0))) // 86400 > 90""",
    "hub": """SELECT root_id, CASE WHEN root_id IN ('src7', 'src17') THEN root_id || '-moved' ELSE root_id END AS repo, ord, rel_path, coalesce(sha256, 'none' || ord) AS sha, size, ord % 3 = 1 AS gone FROM files""",
    "hub_blobs": """SELECT repo, CASE WHEN gone THEN 'x' ELSE '' END || sha || CASE WHEN ord % 19 = 0 THEN '.incomplete' ELSE '' END AS blob, max(size) AS size FROM hub GROUP BY ALL""",
    "hub_links": """SELECT repo, rel_path AS path, CASE WHEN NOT gone THEN sha END AS blob FROM hub""",
    "hub_snaps": """SELECT DISTINCT repo, 'rev' || (ord % 2) AS rev FROM hub""",
    "hub_refs": """SELECT root_id AS repo, 'ref' || ord AS ref, 'rev' || (ord % 4) AS rev FROM hub""",
    "alive": """SELECT repo FROM hub_snaps UNION SELECT repo FROM hub_blobs WHERE blob NOT LIKE '%.incomplete'""",
}

QUERIES: dict[str, str] = {
    "catalog_merge": "SELECT key, size, display_name, architecture, l.v AS size_label, q.v AS quantization FROM models",
    "merge_incremental": "SELECT key, size, display_name, architecture, l.v AS size_label, q.v AS quantization FROM models",
    "location_state": "SELECT key, root_id, kind, rel_path, accessible, dev, ino, state FROM stated",
    "dup_groups": "SELECT * FROM dups",
    "dup_groups_large": """SELECT key, size, display_name, extra_copies, CAST(size * extra_copies AS BIGINT) AS reclaimable FROM parts_big JOIN
        (SELECT key, CAST(sum(n - 1) AS BIGINT) AS extra_copies FROM (SELECT key, dev, count(DISTINCT ino) AS n FROM big WHERE dev <> 0 GROUP BY key, dev) GROUP BY key HAVING sum(n - 1) > 0) USING (key)""",
    "dup_totals": "SELECT count(*) AS groups, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS reclaimable FROM dups",
    "family_usage": """SELECT *, stored_bytes - unique_bytes AS overhead_bytes FROM (SELECT CASE WHEN architecture IS NOT NULL AND l.v IS NOT NULL THEN architecture || ' ' || l.v WHEN architecture IS NOT NULL THEN architecture ELSE regexp_extract(display_name, '^[^ :/]*') END AS family,
        count(*) AS contents, CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(size * greatest(coalesce(n, 0), 1)) AS BIGINT) AS stored_bytes
        FROM models LEFT JOIN (SELECT key, count(DISTINCT (dev, ino)) AS n FROM stated WHERE state = 'Present' GROUP BY key) USING (key) GROUP BY 1)""",
    "family_usage_large": """SELECT family, count(*) AS contents, CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(size * greatest(coalesce(n, 0), 1)) AS BIGINT) AS stored_bytes
        FROM parts_big LEFT JOIN (SELECT key, count(DISTINCT (dev, ino)) AS n FROM big GROUP BY key) USING (key) GROUP BY family""",
    "backup_coverage": "SELECT count(*) FILTER (backed_up) AS backed_up, count(*) AS contents FROM models LEFT JOIN backed USING (key)",
    "backed_up": "SELECT * FROM backed",
    "root_impact": """SELECT root_id, count(*) AS touched, CAST(sum((n = 1)::INT) AS BIGINT) AS only_here, CAST(sum((n = 1)::INT * size) AS BIGINT) AS only_bytes FROM (SELECT DISTINCT key, root_id FROM stated)
        JOIN (SELECT key, count(DISTINCT root_id) AS n FROM stated GROUP BY key) USING (key) JOIN models USING (key) GROUP BY root_id""",
    "root_rollup": "SELECT r.root_id, r.kind, r.online, count(f.ord) AS files, CAST(coalesce(sum(f.size), 0) AS BIGINT) AS bytes FROM roots r LEFT JOIN files f ON f.root_id = r.root_id GROUP BY ALL",
    "status_headline": """SELECT count(*) AS contents, count(*) FILTER (m.key LIKE 'sha256:%') AS hashed, count(*) FILTER (m.key NOT LIKE 'sha256:%') AS pending, count(*) FILTER (NOT s.acc) AS unreachable, count(*) FILTER (NOT s.live) AS offline,
        count(*) FILTER (s.b) AS backed_up, CAST(sum(size) AS BIGINT) AS bytes, (SELECT count(*) FROM dups) AS dup_groups, (SELECT CAST(coalesce(sum(reclaimable), 0) AS BIGINT) FROM dups) AS dup_bytes
        FROM models m JOIN (SELECT key, bool_or(accessible) AS acc, bool_or(state = 'Present') AS live, bool_or(kind = 'removable' AND state <> 'Unreadable') AS b FROM stated GROUP BY key) s USING (key)""",
    "stale_verification": f"SELECT root_id, oldest, CASE WHEN oldest > 0 THEN ({NOW} - oldest) // 86400 END AS days, bytes FROM stale",
    "places": "SELECT key, places FROM place_names",
    "cold_contents": "SELECT key, cold FROM place_names",
    "inventory_view": """SELECT m.key, m.display_name, coalesce(m.q.v, '') AS quant, m.size, p.places, b.backed_up, s.live FROM models m JOIN place_names p USING (key) JOIN backed b USING (key)
        JOIN (SELECT key, count(*) FILTER (state = 'Present') AS live FROM stated GROUP BY key) s USING (key)""",
    "active_view": """SELECT t.key, t.cold AND coalesce(c.cold, true) AS all_cold, t.hit OR coalesce(c.hit, false) AS matches, NOT (t.cold AND coalesce(c.cold, true)) AND (t.hit OR coalesce(c.hit, false)) AS show
        FROM tops t LEFT JOIN (SELECT parent AS key, bool_and(cold) AS cold, bool_or(hit) AS hit FROM children JOIN tops ON tops.key = children.child GROUP BY parent) c USING (key) WHERE t.key NOT IN (SELECT child FROM children)""",
    "bundle": "SELECT key, member FROM bundle",
    "companions": "SELECT * FROM companions",
    "required_by": "SELECT companion, CAST(row_number() OVER (PARTITION BY companion ORDER BY required_by) - 1 AS INT) AS ordinal, required_by FROM companions",
    "split_primary": "SELECT * FROM split_primary",
    "children": "SELECT * FROM children",
    "split_rollup": """SELECT "primary", count(*) AS parts, CAST(sum(size) AS BIGINT) AS size, bool_and(backed_up) AS backed_up FROM (SELECT "primary", part AS key FROM split_primary UNION SELECT "primary", "primary" FROM split_primary) JOIN models USING (key) JOIN backed USING (key) GROUP BY "primary\"""",
    "bundle_union": "SELECT key FROM chosen",
    "deletable_set": "SELECT * FROM deletable",
    "selection_totals": "SELECT count(*) AS contents, CAST(sum(size) AS BIGINT) AS bytes FROM models WHERE key IN (SELECT key FROM chosen)",
    "delete_plan": "SELECT * FROM delete_plan",
    "foreign_commands": "SELECT DISTINCT detail AS command FROM delete_plan WHERE action = 'foreign' AND detail IS NOT NULL",
    "backup_plan": "SELECT key, status, CASE WHEN status = 'copy' THEN r END AS source_root, CASE WHEN status = 'copy' THEN p END AS source_path, CASE WHEN status = 'copy' THEN dest END AS dest_path, size FROM backup",
    "backup_counters": "SELECT status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM backup WHERE key IN (SELECT key FROM chosen) GROUP BY status",
    "verify_report": "SELECT * FROM verify",
    "repair_plan": """SELECT v.root_id, v.rel_path, CASE WHEN count(s.key) > 0 THEN 'repair' ELSE 'unrepairable' END AS status, arg_min(s.root_id, (s.root_id, s.ord)) FILTER (s.key IS NOT NULL) AS source_root, arg_min(s.rel_path, (s.root_id, s.ord)) FILTER (s.key IS NOT NULL) AS source_path
        FROM verify v LEFT JOIN stated s ON s.key = 'sha256:' || v.sha256 AND s.root_id <> v.root_id AND s.state = 'Present' WHERE v.status IN ('mismatched', 'missing', 'unreadable') GROUP BY v.root_id, v.rel_path""",
    "verify_writeback": f"""SELECT f.root_id, f.ord, f.rel_path, CASE WHEN v.status = 'ok' THEN {NOW} ELSE f.verified_unix END AS verified_unix FROM files f
        LEFT JOIN verify v ON v.root_id = f.root_id AND v.rel_path = f.rel_path AND v.status = 'ok'""",
    "repair_counters": """SELECT status, count(*) AS n FROM (SELECT v.root_id, v.rel_path, CASE WHEN count(s.key) > 0 THEN 'repair' ELSE 'unrepairable' END AS status
        FROM verify v LEFT JOIN stated s ON s.key = 'sha256:' || v.sha256 AND s.root_id <> v.root_id AND s.state = 'Present' WHERE v.status IN ('mismatched', 'missing', 'unreadable') GROUP BY v.root_id, v.rel_path) GROUP BY status""",
    "reclaim_counters": """SELECT count(DISTINCT key) FILTER (links) AS contents, CAST(coalesce(sum(paths) FILTER (links), 0) AS BIGINT) AS linked, CAST(coalesce(sum(paths) FILTER (rn > 1 AND NOT links), 0) AS BIGINT) AS skipped_foreign, CAST(coalesce(sum(size) FILTER (links), 0) AS BIGINT) AS bytes
        FROM (SELECT *, rn > 1 AND all_owned AS links FROM (SELECT *, count(*) OVER (PARTITION BY key, dev) AS n, row_number() OVER (PARTITION BY key, dev ORDER BY paths DESC, any_owned DESC, ino) AS rn FROM inodes) JOIN models USING (key) WHERE n > 1)""",
    "offline_owned": "SELECT root_id FROM roots WHERE NOT online AND kind IN ('shelf', 'removable')",
    "verify_lists": "SELECT root_id, rel_path, status FROM verify WHERE status IN ('mismatched', 'unreadable')",
    "unreachable_copies": """SELECT p.key, m.display_name, m.size, p.root_id, coalesce(r.label, r.root_id) AS label, p.rel_path FROM delete_plan p JOIN models m USING (key) JOIN roots r ON r.root_id = p.root_id WHERE p.action = 'offline'""",
    "backup_preview": "SELECT key, display_name, size FROM models WHERE key IN (SELECT key FROM chosen)",
    "cold_count": """SELECT count(*) FILTER (t.cold AND coalesce(c.cold, true)) AS cold FROM tops t LEFT JOIN (SELECT parent AS key, bool_and(cold) AS cold FROM children JOIN tops ON tops.key = children.child GROUP BY parent) c USING (key) WHERE t.key NOT IN (SELECT child FROM children)""",
    "demote_targets": """SELECT key, 'drive' AS target, CASE WHEN key NOT LIKE 'sha256:%' THEN 'not hashed' WHEN NOT on_shelf THEN 'no live shelf copy' ELSE 'demote' END AS status FROM reach
        UNION ALL SELECT key, 'unplugged', 'target offline' FROM reach UNION ALL SELECT key, 'store', 'target not owned' FROM reach""",
    "empty_trash": "SELECT root_id, rel_path, size, 'destroy' AS action FROM files WHERE kind IN ('shelf', 'removable')",
    "scan_dir": """SELECT root_id || '/' || rel_path AS rel_path, size, size AS fp_size, true AS accessible FROM on_disk f
        WHERE lower(rel_path) LIKE '%.gguf' OR EXISTS (SELECT 1 FROM bin w WHERE w.w AND w.root_id = f.root_id AND starts_with(f.rel_path, w.d || '/'))""",
    "file_hashes": "SELECT root_id || '/' || rel_path AS rel_path, h AS sha256, false AS gone FROM on_disk",
    "hash_stream": "SELECT root_id || '/' || rel_path AS rel_path, h AS sha256, CAST(NULL AS VARCHAR) AS error, size AS bytes FROM on_disk",
    "gguf_fields": """SELECT doc_id, (['llama', 'qwen', 'bert'])[doc_id % 3 + 1] AS architecture, lang || ' ' || doc_id AS name,
        coalesce(map {0: 'F32', 1: 'F16', 2: 'Q4_0', 3: 'Q4_1', 7: 'Q8_0', 8: 'Q5_0', 9: 'Q5_1', 10: 'Q2_K', 11: 'Q3_K_S', 12: 'Q3_K_M', 13: 'Q3_K_L', 14: 'Q4_K_S', 15: 'Q4_K_M', 16: 'Q5_K_S', 17: 'Q5_K_M', 18: 'Q6_K', 19: 'IQ2_XXS'}[CAST(doc_id % 20 AS INT)], 'type ' || (doc_id % 20)) AS quantization,
        CAST(1024 + doc_id AS BIGINT) AS context_length, CAST(4096 AS BIGINT) AS embedding_length, doc_id % 5 AS head_count, CASE WHEN doc_id % 2 = 0 THEN CAST(8 AS BIGINT) END AS head_count_kv,
        CASE WHEN doc_id % 5 > 0 AND 4096 % (doc_id % 5) = 0 THEN 4096 // (doc_id % 5) END AS head_dim FROM documents WHERE doc_id % 7 <> 0""",
    "reclaim_plan": """SELECT key, dev, ino, paths, CASE WHEN rn = 1 THEN 'survivor' WHEN all_owned THEN 'link' ELSE 'skipped_foreign' END AS action, CASE WHEN rn > 1 AND all_owned THEN size ELSE 0 END AS frees
        FROM (SELECT *, count(*) OVER (PARTITION BY key, dev) AS n, row_number() OVER (PARTITION BY key, dev ORDER BY paths DESC, any_owned DESC, ino) AS rn FROM inodes) JOIN models USING (key) WHERE n > 1""",
    "reclaim_plan_large": """SELECT key, dev, ino, paths, CASE WHEN rn = 1 THEN 'survivor' WHEN all_owned THEN 'link' ELSE 'skipped_foreign' END AS action, CASE WHEN rn > 1 AND all_owned THEN size ELSE 0 END AS frees
        FROM (SELECT *, count(*) OVER (PARTITION BY key, dev) AS n, row_number() OVER (PARTITION BY key, dev ORDER BY paths DESC, any_owned DESC, ino) AS rn FROM
        (SELECT key, dev, ino, count(*) AS paths, bool_or(kind IN ('shelf', 'removable')) AS any_owned, bool_and(kind IN ('shelf', 'removable')) AS all_owned FROM big WHERE dev <> 0 GROUP BY ALL)) JOIN parts_big USING (key) WHERE n > 1""",
    "archive_plans": """SELECT key, 'promote' AS move, CASE WHEN owned_copy THEN 'already owned' WHEN NOT live THEN 'no reachable copy' ELSE 'promote' END AS status FROM reach
        UNION ALL SELECT key, 'demote', CASE WHEN key NOT LIKE 'sha256:%' THEN 'not hashed' WHEN NOT on_shelf THEN 'no live shelf copy' ELSE 'demote' END FROM reach
        UNION ALL SELECT key, 'restore', CASE WHEN key NOT LIKE 'sha256:%' THEN 'not hashed' WHEN on_shelf THEN 'already on shelf' WHEN on_drive THEN 'restore' WHEN unplugged THEN 'drive offline' ELSE 'no drive copy' END FROM reach""",
    "cold_eligible": "SELECT key FROM reach WHERE on_shelf AND key LIKE 'sha256:%' AND key NOT IN (SELECT child FROM children)",
    "reconcile_carry_forward": """SELECT f.root_id, f.rel_path, CASE WHEN same THEN e_sha END AS sha256, CASE WHEN same THEN e_ver END AS verified_unix, CASE WHEN cur AND e_meta THEN e_arch END AS architecture, NOT cur AS needs_header FROM (
        SELECT f.root_id, f.rel_path, e.sha256 AS e_sha, e.verified_unix AS e_ver, e.has_meta AS e_meta, e.arch AS e_arch,
        coalesce(f.has_fp AND e.has_fp AND f.ord = e.ord AND e.ord % 3 <> 0, false) AS same, coalesce(f.has_fp AND e.has_fp AND f.ord = e.ord AND e.ord % 3 <> 0 AND (NOT e.has_meta OR e.ord % 8 <> 0), false) AS cur
        FROM files f LEFT JOIN earlier e ON e.root_id = f.root_id AND e.rel_path = f.rel_path) f""",
    "stored_carried_merge": """SELECT coalesce(s.root_id, e.root_id) AS root_id, coalesce(s.rel_path, e.rel_path) AS rel_path, coalesce(s.size, e.size) AS size,
        CASE WHEN s.ord IS NULL THEN e.sha256 WHEN s.sha IS NULL AND e.ord IS NOT NULL AND ((NOT s.has_fp AND NOT e.has_fp) OR (s.has_fp AND e.has_fp AND s.ord = e.ord AND e.ord % 3 <> 0)) THEN e.sha256 ELSE s.sha END AS sha256,
        CASE WHEN s.ord IS NULL THEN e.verified_unix WHEN s.sha IS NULL AND e.ord IS NOT NULL AND ((NOT s.has_fp AND NOT e.has_fp) OR (s.has_fp AND e.has_fp AND s.ord = e.ord AND e.ord % 3 <> 0)) THEN e.verified_unix ELSE s.verified_unix END AS verified_unix
        FROM (SELECT * REPLACE (CASE WHEN ord % 6 = 0 THEN 'stored/' || rel_path ELSE rel_path END AS rel_path), CASE WHEN ord % 2 = 0 THEN sha256 END AS sha FROM files) s FULL JOIN earlier e ON e.root_id = s.root_id AND e.rel_path = s.rel_path""",
    "all_manifests": "SELECT f.root_id, f.ord, CASE WHEN r.online AND f.ord % 2 = 0 THEN 'new/' || f.rel_path ELSE f.rel_path END AS rel_path, CASE WHEN r.online THEN f.size + 1 ELSE f.size END AS size FROM files f JOIN roots r USING (root_id)",
    "hash_worklist": "SELECT root_id, rel_path, size FROM files WHERE sha256 IS NULL AND readable",
    "believable_records": "SELECT root_id, rel_path, size FROM files WHERE ord % 9 <> 0 AND ord % 4 <> 0",
    "find_query": """SELECT DISTINCT key, display_name FROM models WHERE starts_with(key, 'sha256:a1') OR contains(lower(display_name), 'a1') OR contains(lower(display_name), 'g1/m-')
        OR key IN (SELECT key FROM stated WHERE contains(lower(rel_path), 'a1') OR contains(lower(rel_path), 'g1/m-'))""",
    "first_per_inode": """SELECT root_id, ord, kind, rel_path, dev, ino FROM (SELECT *, row_number() OVER (PARTITION BY dev, ino ORDER BY rank, ord) AS rn FROM (SELECT root_id, ord, kind, rel_path, CASE WHEN has_fp THEN ord % 3 END AS dev, CASE WHEN has_fp THEN ord // 4 END AS ino, CASE kind WHEN 'ollama' THEN 1 WHEN 'hf_hub' THEN 2 ELSE 0 END AS rank FROM files)) WHERE rn = 1 OR dev IS NULL""",
    "provenance_lookup": """SELECT m.key, p.url AS repo FROM models m LEFT JOIN (SELECT 'sha256:' || CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE reverse(sha256(text)) END AS key, min(doc_id) AS d FROM documents GROUP BY 1) r USING (key) LEFT JOIN pages p ON p.page_id = r.d""",
    "orphan_blobs": """SELECT 'incomplete_download' AS kind, repo AS subject, 'blobs/' || blob AS detail, size AS bytes FROM hub_blobs WHERE blob LIKE '%.incomplete'
        UNION ALL SELECT 'pruned_husk', repo, 'refs remain (' || string_agg(ref || ' → ' || substr(rev, 1, 12), ', ' ORDER BY ref || ' → ' || substr(rev, 1, 12)) || ') but all content is pruned', 0 FROM hub_refs WHERE repo NOT IN (SELECT repo FROM alive) GROUP BY repo
        UNION ALL SELECT 'dangling_ref', r.repo, 'refs/' || ref || ' → ' || substr(r.rev, 1, 12) || ' has no snapshot', 0 FROM hub_refs r WHERE repo IN (SELECT repo FROM alive) AND NOT EXISTS (SELECT 1 FROM hub_snaps s WHERE s.repo = r.repo AND s.rev = r.rev)
        UNION ALL SELECT 'dangling_snapshot_link', l.repo, l.path, 0 FROM hub_links l WHERE l.blob IS NULL
        UNION ALL SELECT 'orphan_blob', b.repo, 'blobs/' || substr(b.blob, 1, 16) || ' referenced by no snapshot', size FROM hub_blobs b WHERE b.blob NOT LIKE '%.incomplete' AND NOT EXISTS (SELECT 1 FROM hub_links l WHERE l.repo = b.repo AND l.blob = b.blob)""",
    "missing_layers": """SELECT 'missing_ollama_blob' AS kind, name AS subject, coalesce(sha256, 'none') AS detail, size AS bytes FROM files f WHERE kind = 'ollama' AND NOT EXISTS (SELECT 1 FROM files b WHERE b.readable AND b.ord % 2 = 0 AND b.sha256 = coalesce(f.sha256, 'none'))""",
    "findings_summary": "SELECT 'stale_verification' AS kind, 'stale verification' AS label, false AS executable, count(*) AS findings, CAST(sum(bytes) AS BIGINT) AS bytes FROM stale HAVING count(*) > 0",
    "journal_tail": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type || ' ' || user_id || ' ' || event_id AS line FROM events ORDER BY event_id DESC LIMIT 50",
    "journal_lines": "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type || ' ' || user_id || ' ' || event_id AS line FROM events",
    "group_listing": """SELECT CASE WHEN p IS NOT NULL THEN p || '.gguf (' || c || ' parts)' ELSE first END AS display, first, parts, total, ord FROM (SELECT any_value(p) AS p, any_value(c) AS c, arg_min(filename, ord) AS first, count(*) AS parts, CASE WHEN count(size) = count(*) THEN CAST(sum(size) AS BIGINT) END AS total, min(ord) AS ord
        FROM (SELECT *, CASE WHEN regexp_matches(filename, '-\\d{5}-of-\\d{5}\\.gguf$') THEN regexp_extract(filename, '^(.*)-\\d{5}-of-', 1) END AS p, TRY_CAST(regexp_extract(filename, '-of-(\\d{5})\\.gguf$', 1) AS INT) AS c FROM listing) GROUP BY coalesce(p || '-of-' || c, filename))""",
    "split_completeness": """SELECT chosen, w AS filename, w IN (SELECT filename FROM listing) AS listed FROM (SELECT filename AS chosen, CASE WHEN regexp_matches(filename, '-\\d{5}-of-\\d{5}\\.gguf$') THEN regexp_extract(filename, '^(.*)-\\d{5}-of-', 1) || '-' || lpad(CAST(i AS VARCHAR), 5, '0') || '-of-00003.gguf' ELSE filename END AS w
        FROM listing, range(1, 4) t(i) WHERE (filename LIKE '%-0000%' OR filename LIKE '%other%') AND (i = 1 OR regexp_matches(filename, '-\\d{5}-of-\\d{5}\\.gguf$')))""",
    "projector_pick": """SELECT filename FROM listing WHERE lower(filename) LIKE '%mmproj%' ORDER BY CASE WHEN lower(filename) LIKE '%f16%' AND lower(filename) NOT LIKE '%bf16%' THEN 0 WHEN lower(filename) LIKE '%bf16%' THEN 1 ELSE 2 END, ord LIMIT 1""",
    "snapshot_set": "SELECT filename FROM listing WHERE ord % 4 <> 0",
    "restore_set": """SELECT a.root_id, a.rel_path AS asked, b.rel_path FROM asked a JOIN bin b ON b.root_id = a.root_id WHERE (a.whole AND starts_with(b.rel_path, a.d || '/')) OR (NOT a.whole AND b.rel_path = a.rel_path)
        OR (NOT a.whole AND NOT a.p AND b.d = a.d AND b.rel_path <> a.rel_path AND (b.p OR b.set_name = a.set_name))""",
    "trash_names": """SELECT root_id, file AS rel_path, ord, CASE WHEN rn = 0 THEN file WHEN contains(file, '.') THEN regexp_replace(file, '^(.*)\\.([^.]*)$', '\\1.' || rn || '.\\2') ELSE file || '.' || rn END AS trash_path
        FROM (SELECT root_id, split_part(rel_path, '/', -1) AS file, ord, row_number() OVER (PARTITION BY root_id, split_part(rel_path, '/', -1) ORDER BY ord) - 1 AS rn FROM files)""",
    "store_layers": """SELECT name || CASE WHEN ord % 3 = 0 THEN '+projector' ELSE '' END AS display_name, 'blobs/sha256-' || substr(coalesce(sha256, root_id), 1, 12) AS rel_path, size FROM files WHERE kind = 'ollama' AND ord % 3 < 2 QUALIFY row_number() OVER (PARTITION BY name, ord % 3 ORDER BY ord) = 1""",
    "scan_order": "SELECT kind, root_id, rel_path, CASE kind WHEN 'ollama' THEN name WHEN 'hf_hub' THEN name || ' — ' || regexp_replace(file, '^(.+)\\.[^.]*$', '\\1') ELSE regexp_replace(file, '^(.+)\\.[^.]*$', '\\1') END AS display_name FROM keyed",
    "scalar_format": f"""SELECT ord, CASE WHEN z < 1024 THEN z || ' B' ELSE (r // 10) || '.' || (r % 10) || u END AS human,
        CASE WHEN a <= 90 THEN a || 's ago' WHEN a <= 5400 THEN (a // 60) || ' min ago' WHEN a <= 172800 THEN (a // 3600) || ' hours ago' ELSE (a // 86400) || ' days ago' END AS ago,
        strftime(make_timestamp(ord * 86461 * 1000000), '%Y-%m-%d %H:%M:%S') AS at, substr(sha256, 1, 12) AS short, CASE WHEN length(rel_path) > 12 THEN substr(rel_path, 1, 11) || '…' ELSE rel_path END AS cut,
        coalesce(map {{0: 'F32', 1: 'F16', 2: 'Q4_0', 3: 'Q4_1', 7: 'Q8_0', 8: 'Q5_0', 9: 'Q5_1', 10: 'Q2_K', 11: 'Q3_K_S', 12: 'Q3_K_M', 13: 'Q3_K_L', 14: 'Q4_K_S', 15: 'Q4_K_M', 16: 'Q5_K_S', 17: 'Q5_K_M', 18: 'Q6_K', 19: 'IQ2_XXS', 20: 'IQ2_XS', 24: 'IQ4_NL', 25: 'IQ4_XS', 30: 'BF16'}}[CAST(ord % 40 AS INT)], 'type ' || (ord % 40)) AS file_type,
        coalesce(CASE WHEN ord % 9 = 0 THEN ord END, CASE WHEN ord % 5 > 0 AND size % (ord % 5) = 0 THEN size // (ord % 5) END) AS head_dim, ord * 100 // greatest(size, 1) AS percent
        FROM (SELECT *, CASE WHEN z < 1048576 THEN ' KiB' WHEN z < 1073741824 THEN ' MiB' WHEN z < 1099511627776 THEN ' GiB' ELSE ' TiB' END AS u, z * 10 // w + CASE WHEN 2 * (z * 10 % w) > w OR (2 * (z * 10 % w) = w AND (z * 10 // w) % 2 = 1) THEN 1 ELSE 0 END AS r
        FROM (SELECT *, size * size * 37 AS z, CASE WHEN size * size * 37 < 1048576 THEN 1024 WHEN size * size * 37 < 1073741824 THEN 1048576 WHEN size * size * 37 < 1099511627776 THEN 1073741824 ELSE 1099511627776 END AS w, greatest({NOW} - coalesce(verified_unix, {NOW} + 5), 0) AS a FROM files))""",
    "scalar_paths": """SELECT k.ord, k.file, regexp_replace(k.file, '^(.+)\\.[^.]*$', '\\1') AS stem, s.box AS container, CASE WHEN k.ord % 7 IN (1, 2) THEN NULL ELSE k.rel_path END AS clean, CASE WHEN s.part IS NOT NULL THEN s.prefix END AS prefix, s.part, s.parts, s.weights, s.projector,
        CASE k.kind WHEN 'ollama' THEN translate(shown, ':/', '--') || '/' || translate(shown, ':/', '--') || '.gguf' WHEN 'hf_hub' THEN split_part(shown, '/', -1) || '/' || array_to_string(string_split(k.rel_path, '/')[4:], '/') ELSE k.rel_path END AS dest,
        CASE k.kind WHEN 'ollama' THEN 'ollama rm ' || replace(shown, '+projector', '') WHEN 'hf_hub' THEN 'hf cache rm model/' || replace(substr(split_part(k.rel_path, '/', 1), 9), '--', '/') || ' -y' END AS command,
        CASE k.kind WHEN 'hf_hub' THEN 'hf-hub' WHEN 'removable' THEN 'drive' ELSE k.kind END || '-' || substr(sha256(k.root_id), 1, 8) AS root,
        CASE WHEN k.ord % 7 IN (1, 2) THEN NULL WHEN k.ord % 7 = 0 THEN '/shelf/name/./' || k.rel_path ELSE '/shelf/name/' || k.rel_path END AS dest_for
        FROM keyed k JOIN stated s ON s.root_id = k.root_id AND s.ord = k.ord""",
    "usage_totals": """SELECT CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(size * greatest(coalesce(n, 0), 1)) AS BIGINT) AS stored_bytes, CAST(sum(size * greatest(coalesce(n, 0), 1)) - sum(size) AS BIGINT) AS overhead_bytes
        FROM models LEFT JOIN (SELECT key, count(DISTINCT (dev, ino)) AS n FROM stated WHERE state = 'Present' GROUP BY key) USING (key)""",
    "scan_footer": "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (NOT readable) AS missing FROM files",
    "trash_totals": "SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM files WHERE kind IN ('shelf', 'removable') AND lower(rel_path) LIKE '%m-%'",
    "findings_total": "SELECT count(*) AS findings, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM stale",
    "resolve_root": "SELECT root_id, kind FROM roots WHERE root_id IN ('src3', 'src6') OR label = 'disk src4'",
    "distinct_folders": "SELECT array_to_string(string_split(rel_path, '/')[:-2], '/') AS folder, min(ord) AS ord FROM files GROUP BY 1",
    "ambiguous_matches": "SELECT key, display_name FROM models ORDER BY key LIMIT 10",
    "first_live_source": "SELECT key, s.r AS root_id, s.p AS rel_path FROM first_live",
    "log_lines": """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'hashed f' || user_id || ' in ' || (event_id % 100) || 's' WHEN 1 THEN 'hash FAILED f' || user_id || ': ' || event_type WHEN 2 THEN 'verified f' || user_id || ' in ' || (event_id % 100) || 's'
        WHEN 3 THEN 'skipped f' || user_id || ': ' || event_type WHEN 5 THEN 'relinked f' || user_id WHEN 6 THEN 'skipped f' || user_id || ' (foreign store — never touched)' WHEN 7 THEN 'hashing f' || user_id
        WHEN 8 THEN 'downloading f' || user_id || ' (' || CASE WHEN event_id % 4 > 1 THEN (event_id % 1000) || ' B' ELSE 'size unknown' END || ')' || CASE event_id % 3 WHEN 1 THEN ', resuming at 512 B' WHEN 2 THEN ', resuming at 1.0 KiB' ELSE '' END
        WHEN 9 THEN 'connection dropped — resuming f' || user_id || ' at ' || CASE event_id % 3 WHEN 0 THEN '0 B' WHEN 1 THEN '512 B' ELSE '1.0 KiB' END || ' (attempt ' || (event_id % 5) || ')' END AS line FROM events""",
    "header_pick": """SELECT file, value FROM (SELECT root_id AS file, CASE ord % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS rank, min(ord) AS value FROM files WHERE ord % 3 < 2 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY file ORDER BY rank) = 1""",
    "journal_activity": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS operation, count(*) AS entries FROM events GROUP BY ALL",
    "url_scalars": """SELECT page_id, url_encode(url || ' é~*?') AS raw, regexp_matches(regexp_extract(url, 'https?://[^/]*/(.*)', 1), '^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$') AS valid,
        CASE WHEN page_id % 3 = 0 THEN sha256(url) END AS etag, true AS ok FROM pages""",
}
QUERIES["find_indexed"] = QUERIES["find_query"]
QUERIES["walk_dir"] = QUERIES["scan_dir"]
QUERIES["url_scalars"] = "SELECT page_id, replace(replace(replace(raw, '+', '%20'), '%2F', '/'), '*', '%2A') AS path, valid, etag, ok FROM (" + QUERIES["url_scalars"] + ")"


def sql(name: str) -> str:
    """The query with the views that it needs, directly or not."""
    import re

    text, needed = QUERIES[name], set()
    for view in reversed(VIEWS):
        if any(re.search(rf"\b{view}\b", t) for t in [text, *(VIEWS[n] for n in needed)]):
            needed.add(view)
    return ("WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in needed) + "\n" if needed else "") + text


ORACLE_SQL: dict[str, str] = {name: sql(name) for name in QUERIES}
