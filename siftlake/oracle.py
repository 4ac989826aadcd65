"""DuckDB SQL that should give the same rows as the queries, from the plain tables alone."""

from __future__ import annotations

HUMAN = "human-presence-v3-direct-seek"

# Fixed values, stated here once more so that the SQL does not lean on the engine.
STILL = "('.jpg', '.jpeg', '.png', '.heic', '.heif', '.webp', '.tif', '.tiff', '.bmp', '.raw', '.cr2', '.nef', '.arw', '.dng', '.gif')"
MOVING = "('.mp4', '.mov', '.m4v', '.avi', '.mkv', '.webm', '.mts', '.m2ts', '.wmv', '.flv', '.3gp')"

REC = f"""
lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
doc AS (
    SELECT d.doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, n_chars, toxic,
           CASE lang WHEN 'en' THEN '.jpg' WHEN 'de' THEN '.gif' WHEN 'fr' THEN '.mp4' WHEN 'es' THEN '.png' ELSE '.bin' END AS ext,
           1600000000 + (d.doc_id * 7919) % 1000000 AS seconds
    FROM documents d LEFT JOIN lab USING (doc_id)),
rec AS (
    SELECT doc_id, '/' || source || '/' || lang || '/doc' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ext AS path,
           CAST(strlen(text) AS BIGINT) AS size, CAST(seconds + 0.5 AS DOUBLE) AS mtime,
           CASE WHEN doc_id % 5 <> 0 THEN seconds * 1000000000 + doc_id END AS mtime_ns,
           CASE ext WHEN '.jpg' THEN 'image' WHEN '.gif' THEN 'gif' WHEN '.mp4' THEN 'video' WHEN '.png' THEN 'image' ELSE 'other' END AS media_type,
           ext AS extension, CAST(1 AS BIGINT) AS device, doc_id - CASE WHEN doc_id % 20 = 1 THEN 1 ELSE 0 END AS inode,
           CASE WHEN doc_id % 17 <> 0 THEN n_chars END AS width, CASE WHEN doc_id % 17 <> 0 THEN 1 + doc_id % 3 END AS height,
           sha256(text) AS sha256,
           CASE toxic WHEN 1 THEN 'person_detected' WHEN 0 THEN 'no_person_detected' ELSE 'analysis_failed' END AS status,
           CASE WHEN doc_id % 11 = 0 THEN 'human-presence-v2' ELSE '{HUMAN}' END || '|opencv|0.4' AS signature,
           CASE WHEN doc_id % 7 <> 0 THEN doc_id % 4 END AS face_count,
           CASE WHEN doc_id % 13 = 0 THEN 'image hash: fault ' || CAST(doc_id % 3 AS VARCHAR) END AS error, '/' || source AS root, text
    FROM doc),
recs AS (
    SELECT *, coalesce(CAST(width AS BIGINT) * height, 0) AS pixels, coalesce(mtime_ns, CAST(mtime * 1e9 AS BIGINT)) AS stamp,
           len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1 AS depth, len(string_split(path, '/')[-1]) AS namelen
    FROM rec)"""

BEST = "pixels DESC, size DESC, stamp DESC, depth, namelen"

EXACT = (
    REC
    + f""",
ex AS (
    SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER (PARTITION BY sha256 ORDER BY {BEST}, path) = 1 AS is_keep,
           row_number() OVER (PARTITION BY sha256 ORDER BY path) AS ord
    FROM recs WHERE size > 0),
exid AS (SELECT sha256, substr(sha1('exact|' || string_agg(path, '|' ORDER BY path)), 1, 12) AS group_id FROM ex WHERE n > 1 GROUP BY sha256),
mem AS (SELECT ex.*, group_id, 'exact' AS kind, NOT is_keep AS is_selected, FALSE AS is_reviewed FROM ex JOIN exid USING (sha256))"""
)

STATE = (
    EXACT
    + f""",
low AS (SELECT *, row_number() OVER (ORDER BY pixels, path) AS o FROM recs WHERE media_type IN ('image', 'gif', 'video') AND pixels > 0 AND pixels < 2000),
ppl AS (SELECT *, row_number() OVER (ORDER BY path) AS o FROM recs WHERE status = 'no_person_detected' AND string_split(signature, '|')[1] = '{HUMAN}'),
state AS (
    SELECT group_id, kind, ord, path, size, is_keep, is_selected, is_reviewed, mtime, media_type, width, height, face_count, error, status, signature FROM mem
    UNION ALL SELECT 'low', 'low_resolution', o, path, size, FALSE, doc_id % 2 = 0, doc_id % 3 <> 0, mtime, media_type, width, height, face_count, error, status, signature FROM low
    UNION ALL SELECT 'ppl', 'no_humans', o, path, size, FALSE, doc_id % 2 = 0, doc_id % 3 <> 0, mtime, media_type, width, height, face_count, error, status, signature FROM ppl),
veto AS (SELECT DISTINCT path FROM state WHERE kind <> 'exact' AND is_reviewed AND NOT is_selected),
picked AS (SELECT DISTINCT path, size FROM state WHERE is_selected AND (kind = 'exact' OR is_reviewed) AND path NOT IN (SELECT path FROM veto)),
freed AS (
    SELECT m.group_id, max(CASE WHEN is_keep THEN m.path END) AS keep FROM mem m LEFT JOIN picked p USING (path)
    GROUP BY m.group_id HAVING count(p.path) = count(*)),
eff AS (SELECT path, size FROM picked WHERE path NOT IN (SELECT keep FROM freed))"""
)

_bits = ", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))
_code = " + ".join(f"(CASE WHEN 2 * b{b} > n THEN CAST({-(1 << 63) if b == 63 else 1 << b} AS HUGEINT) ELSE 0 END)" for b in range(64))


def codes(tokens: str, keys: str) -> str:
    """SQL for a code of the distinct tokens of each value of keys; tokens: a relation of keys and token."""
    return f"""SELECT {keys}, CAST({_code} AS BIGINT) AS code FROM (
        SELECT {keys}, count(*) AS n, {_bits} FROM (
            SELECT {keys}, CAST('0x' || substr(md5(token), 1, 16) AS UBIGINT) AS h FROM (SELECT DISTINCT {keys}, token FROM {tokens})) GROUP BY {keys})"""


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\pL\\pN]+'), lambda x: x <> '')"


def piece(a: int, b: int) -> str:
    return words(f"substr(text, CAST(length(text) * {a} // 4 AS BIGINT) + 1, CAST(length(text) * {b} // 4 - length(text) * {a} // 4 AS BIGINT))")


CODES = f"""
txt AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
wrd AS (SELECT doc_id, text, {words('text')} AS w FROM txt),
tok AS (
    SELECT doc_id, 0 AS kind, unnest(w) AS token FROM wrd
    UNION ALL SELECT doc_id, 1, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM wrd)
    {" ".join(f"UNION ALL SELECT doc_id, {k + 2}, unnest({piece(a, b)}) FROM txt" for k, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (3, 4), (1, 3)]))}),
cod AS ({codes('tok', 'doc_id, kind')}),
fp AS (
    SELECT doc_id, max(code) FILTER (kind = 0) AS phash, max(code) FILTER (kind = 1) AS dhash,
           CASE WHEN count(*) FILTER (kind >= 2) = 5 THEN list(code ORDER BY kind) FILTER (kind >= 2) END AS tiles
    FROM cod GROUP BY doc_id)"""



def pairs(code: int = 6, gradient: int = 10, tile: int = 8, tiles: int = 25, aspect: float = 0.15) -> str:
    """SQL for the records with codes, ranked, and the pairs of them that are near."""
    return f"""
pool AS (
    SELECT r.*, phash, dhash, tiles, CASE WHEN width > 0 AND height > 0 THEN width / height END AS aspect,
           row_number() OVER (ORDER BY {BEST.replace('depth, namelen', 'depth, namelen, path DESC')}) AS k
    FROM recs r JOIN fp USING (doc_id) WHERE media_type IN ('image', 'gif') AND phash IS NOT NULL),
near AS (
    SELECT a.k AS ka, b.k AS kb, a.path AS pa, b.path AS pb, a.root AS ra, b.root AS rb FROM pool a JOIN pool b ON a.k < b.k
    WHERE bit_count(xor(a.phash, b.phash)) <= {code} AND coalesce(bit_count(xor(a.dhash, b.dhash)) <= {gradient}, TRUE)
      AND coalesce(abs(a.aspect - b.aspect) <= {aspect}, TRUE) AND a.tiles IS NOT NULL AND b.tiles IS NOT NULL
      AND list_max([bit_count(xor(a.tiles[i], b.tiles[i])) for i in range(1, 6)]) <= {tile}
      AND list_sum([CAST(bit_count(xor(a.tiles[i], b.tiles[i])) AS INTEGER) for i in range(1, 6)]) <= {tiles})"""


PAIRS, WIDE = pairs(), pairs(12, 30, 40, 160, 1e6)


def clusters(same_root: bool) -> str:
    """SQL for the walk from the best on: a node becomes a keeper unless a better keeper is near."""
    near = "near WHERE ra = rb" if same_root else "near"
    return f"""
lnk AS (SELECT ka, kb FROM {near}),
nod AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT ka AS k FROM lnk UNION SELECT kb FROM lnk)),
adj AS (SELECT n.i, n.k, list(m.i) FILTER (m.i IS NOT NULL) AS better FROM nod n LEFT JOIN lnk ON lnk.kb = n.k LEFT JOIN nod m ON m.k = lnk.ka GROUP BY n.i, n.k),
fold(i, keepers) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
    UNION ALL
    SELECT adj.i, CASE WHEN coalesce(list_has_any(adj.better, fold.keepers), FALSE) THEN fold.keepers ELSE list_append(fold.keepers, adj.i) END
    FROM fold JOIN adj ON adj.i = fold.i + 1),
kept AS (SELECT unnest(keepers) AS i FROM fold WHERE i = (SELECT coalesce(max(i), 0) FROM nod)),
own AS (
    SELECT n.k, coalesce((SELECT min(q.k) FROM lnk JOIN nod q ON q.k = lnk.ka JOIN kept ON kept.i = q.i WHERE lnk.kb = n.k AND n.i NOT IN (SELECT i FROM kept)), n.k) AS keeper
    FROM nod n),
cl AS (SELECT p.*, o.keeper, count(*) OVER (PARTITION BY o.keeper) AS n FROM own o JOIN pool p ON p.k = o.k),
clid AS (SELECT keeper, substr(sha1('similar|' || string_agg(path, '|' ORDER BY path)), 1, 12) AS group_id FROM cl WHERE n > 1 GROUP BY keeper),
sim AS (SELECT cl.*, group_id, cl.k = cl.keeper AS is_keep, row_number() OVER (PARTITION BY cl.keeper ORDER BY path) AS ord FROM cl JOIN clid USING (keeper))"""


CONV = f"""
trn AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
ttok AS (SELECT conv_id, turn, unnest({words('text')}) AS token FROM trn),
tcod AS ({codes('ttok', 'conv_id, turn')}),
tw AS (SELECT conv_id, turn, sum(length(text)) AS chars FROM trn GROUP BY conv_id, turn),
sq AS (
    SELECT conv_id AS id, CAST(sum(chars) AS DOUBLE) AS duration,
           CASE WHEN count(code) = count(*) THEN list(code ORDER BY turn) END AS frames
    FROM tw LEFT JOIN tcod USING (conv_id, turn) GROUP BY conv_id)"""

_signs = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN CAST({-(1 << 63) if i == 63 else 1 << i} AS HUGEINT) ELSE 0 END)" for i in range(64))
SIGNS = f"sg AS (SELECT vec_id, label, CAST({_signs} AS BIGINT) AS code FROM embeddings WHERE len(embedding) >= 64)"
SIGN_EDGES = f"""{SIGNS}, sd AS (SELECT DISTINCT code FROM sg),
se AS (SELECT a.code AS code_a, b.code AS code_b, CAST(bit_count(xor(a.code, b.code)) AS BIGINT) AS distance FROM sd a JOIN sd b ON a.code < b.code WHERE bit_count(xor(a.code, b.code)) <= 15)"""

RCP = """
rcp AS (
    SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, event_type = 'view' AS dry_run, CASE WHEN event_type = 'purchase' THEN 'quarantine' ELSE 'trash' END AS action,
           ts AS started_at, event_type <> 'error' AS ok, event_type = 'purchase' AS dest, CAST(floor(value * 100) AS BIGINT) AS size
    FROM events)"""

CACHE = """
cac AS (
    SELECT CASE WHEN doc_id % 9 = 0 THEN '/old' || path ELSE path END AS path, size, mtime + CASE WHEN doc_id % 6 = 0 THEN 5 ELSE 0 END AS mtime,
           mtime_ns + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS mtime_ns, media_type, doc_id * 10 AS inode, sha1(sha256) AS sha,
           CASE WHEN doc_id % 8 = 0 THEN 'v1' ELSE 'v2' END AS ver, CASE WHEN doc_id % 4 <> 0 THEN 9 END AS faces FROM rec),
hit AS (
    SELECT r.path, c.path AS cached_path, c.sha, c.faces, c.media_type FROM rec r JOIN cac c ON c.ver = 'v2' AND r.size = c.size
        AND (r.path = c.path OR (r.doc_id * 10 = c.inode AND r.media_type = c.media_type AND NOT EXISTS (SELECT 1 FROM cac x WHERE x.ver = 'v2' AND x.path = r.path AND x.size = r.size)))
    WHERE r.doc_id * 10 = c.inode AND CASE WHEN r.mtime_ns IS NOT NULL AND c.mtime_ns IS NOT NULL THEN r.mtime_ns = c.mtime_ns ELSE abs(r.mtime - c.mtime) < 0.001 END)"""

NOW = """
now AS (
    SELECT path, size + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS size, mtime + CASE WHEN doc_id % 23 = 0 THEN 9 ELSE 0 END AS mtime,
           mtime_ns + CASE WHEN doc_id % 23 = 0 THEN 9 ELSE 0 END AS mtime_ns, doc_id * 10 + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END AS inode,
           doc_id % 31 = 0 AS is_symlink, doc_id % 37 <> 0 AS is_regular, CASE WHEN doc_id % 19 = 0 THEN sha1(sha256) ELSE sha256 END AS sha
    FROM rec WHERE error IS DISTINCT FROM 'image hash: fault 1')"""


def checked(roots: bool) -> str:
    outside = "WHEN NOT (r.root IN ('/src1', '/src2', '/src3', '/src4')) THEN 'file is outside the scanned roots'" if roots else ""
    return f"""
chk AS (
    SELECT r.path, CASE WHEN n.path IS NULL THEN '[Errno 2] No such file or directory: ' || chr(39) || r.path || chr(39) WHEN is_symlink THEN 'refusing to act on a symbolic link'
        WHEN NOT is_regular THEN 'file no longer exists' {outside} WHEN r.size <> n.size THEN 'file changed since scan (size ' || r.size || ' -> ' || n.size || ')'
        WHEN r.doc_id * 10 <> n.inode THEN 'file changed since scan (inode differs)'
        WHEN CASE WHEN r.mtime_ns IS NOT NULL THEN r.mtime_ns <> n.mtime_ns ELSE abs(r.mtime - n.mtime) >= 0.001 END THEN 'file changed since scan (modified time differs)' END AS error
    FROM rec r LEFT JOIN now n USING (path))"""


PREFLIGHT = (
    EXACT
    + f", {NOW}, {checked(False)}"
    + """,
sel AS (SELECT * FROM mem WHERE NOT is_keep),
kpr AS (
    SELECT m.group_id, n.sha AS keep_now, CASE
        WHEN c.error IS NULL OR ((contains(c.error, 'modified time') OR contains(c.error, 'inode')) AND m.size = n.size)
        THEN CASE WHEN n.sha IS DISTINCT FROM m.sha256 THEN 'retained member content no longer matches its scan hash' END
        ELSE 'retained member is stale: ' || c.error END AS keep_error
    FROM mem m JOIN chk c USING (path) LEFT JOIN now n USING (path) WHERE m.is_keep),
pre AS (
    SELECT s.path, s.group_id, s.size, coalesce(c.error, k.keep_error, CASE WHEN n.sha IS DISTINCT FROM s.sha256 OR k.keep_now IS DISTINCT FROM s.sha256 THEN 'content is no longer equal to the retained member' END) AS error
    FROM sel s LEFT JOIN chk c USING (path) LEFT JOIN now n USING (path) LEFT JOIN kpr k ON k.group_id = s.group_id),
pln AS (
    SELECT path, group_id, error IS NULL AS ok, CASE WHEN error IS NULL THEN '/quarantine/' || string_split(path, '/')[-1] END AS destination, error FROM pre)"""
)

_rule_order = {
    "automatic": "is_keep DESC", "newest": "mtime DESC", "oldest": "mtime", "largest": "pixels DESC, size DESC",
    "smallest": "CASE WHEN pixels > 0 THEN pixels ELSE size END, size", "shortest_path": "depth, length(path)",
}

_hex = lambda c: f"lower(lpad(hex(CAST(CASE WHEN {c} < 0 THEN CAST({c} AS HUGEINT) + 18446744073709551616 ELSE {c} END AS UBIGINT)), 16, '0'))"

SQL: dict[str, str] = {
    "near_dup_edges_verified": f"""WITH {REC}, {CODES}, {PAIRS},
        cls AS (SELECT phash, dhash, tiles, aspect, min(path) AS p FROM (SELECT DISTINCT r.path, phash, dhash, tiles, CASE WHEN width > 0 AND height > 0 THEN width / height END AS aspect FROM rec r JOIN fp USING (doc_id) WHERE phash IS NOT NULL) GROUP BY phash, dhash, tiles, aspect)
        SELECT a.p AS path_a, b.p AS path_b FROM cls a JOIN cls b ON a.p <= b.p
        WHERE bit_count(xor(a.phash, b.phash)) <= 6 AND coalesce(bit_count(xor(a.dhash, b.dhash)) <= 10, TRUE)
          AND coalesce(abs(a.aspect - b.aspect) <= 0.15, TRUE) AND a.tiles IS NOT NULL AND b.tiles IS NOT NULL
          AND list_max([bit_count(xor(a.tiles[i], b.tiles[i])) for i in range(1, 6)]) <= 8
          AND list_sum([CAST(bit_count(xor(a.tiles[i], b.tiles[i])) AS INTEGER) for i in range(1, 6)]) <= 25""",
    "tagged_codes": f"""WITH {CODES} SELECT doc_id, 't2:' || {" || ',' || ".join(_hex(f"tiles[{i}]") for i in range(1, 6))} AS text, TRUE AS same, TRUE AS other_tag_is_null FROM fp WHERE tiles IS NOT NULL""",
    "next_unreviewed": f"""WITH {STATE}, u AS (SELECT ord, CASE WHEN NOT is_reviewed THEN ord END AS o FROM state WHERE kind = 'low_resolution')
        SELECT ord, coalesce(min(o) OVER (ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(o) OVER ()) AS next_ord FROM u""",
    "path_functions": """SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(url, '/[^/]*$', '') AS parent,
        CAST(len(list_filter(string_split(url, '/'), lambda x: x <> '')) AS BIGINT) AS depth,
        substr(coalesce(nullif(trim(regexp_replace(url, '[^\\pL\\pN._\\- ()\\[\\]]', '_', 'g'), ' ._'), ''), 'file'), 1, 40) AS safe, sha256(CAST(page_id AS VARCHAR) || chr(0) || url) AS thumbnail FROM pages""",
    "format_bytes": """WITH n AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) * pow(1000.0, doc_id % 5) AS BIGINT) AS n FROM documents)
        SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0)
        WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0) ELSE printf('%.1f TB', n / 1099511627776.0) END AS text FROM n""",
    "undo_plan": f"""WITH {PREFLIGHT}, it AS (SELECT *, CAST(regexp_extract(path, 'doc(\\d+)', 1) AS BIGINT) AS o FROM pln WHERE ok),
        there AS (SELECT destination AS path FROM it WHERE o % 7 <> 0 UNION SELECT path FROM pln WHERE CAST(regexp_extract(path, 'doc(\\d+)', 1) AS BIGINT) % 11 = 0)
        SELECT destination AS source, path AS destination, CASE WHEN it.destination NOT IN (SELECT path FROM there) THEN 'quarantined file is missing' WHEN path IN (SELECT path FROM there) THEN 'original location is occupied' END AS error FROM it""",
    "near_dup_clusters": f"WITH RECURSIVE {REC}, {CODES}, {PAIRS}, {clusters(False)} SELECT group_id, path, is_keep, size FROM sim",
    "near_dup_edges": f"WITH {CODES}, c AS (SELECT DISTINCT phash AS c FROM fp WHERE phash IS NOT NULL) SELECT a.c AS code_a, b.c AS code_b, CAST(bit_count(xor(a.c, b.c)) AS BIGINT) AS distance FROM c a JOIN c b ON a.c < b.c WHERE bit_count(xor(a.c, b.c)) <= 6",
    "near_dup_classes": f"WITH {CODES} SELECT doc_id, phash AS code, lower(lpad(hex(CAST(CASE WHEN phash < 0 THEN CAST(phash AS HUGEINT) + 18446744073709551616 ELSE phash END AS UBIGINT)), 16, '0')) AS hex FROM fp WHERE phash IS NOT NULL",
    "near_dup_not_exact_subset": f"""WITH RECURSIVE {EXACT}, {CODES}, {WIDE}, {clusters(False)},
        held AS (SELECT s.group_id, count(*) AS n, count(m.group_id) AS h, count(DISTINCT m.group_id) AS g FROM sim s LEFT JOIN mem m USING (path) GROUP BY s.group_id)
        SELECT group_id, n AS member_count FROM held WHERE NOT (n = h AND g = 1)""",
    "per_root_clusters": f"WITH RECURSIVE {REC}, {CODES}, {WIDE}, {clusters(True)} SELECT root, group_id, path, is_keep FROM sim",
    "reviewed_pairs_dropped": f"WITH {CODES}, c AS (SELECT DISTINCT phash AS c FROM fp WHERE phash IS NOT NULL) SELECT a.c AS code_a, b.c AS code_b FROM c a JOIN c b ON a.c < b.c WHERE bit_count(xor(a.c, b.c)) <= 6 AND bit_count(xor(a.c, b.c)) % 2 = 0",
    "exact_groups": f"WITH {EXACT} SELECT group_id, count(*) AS member_count, max(path) FILTER (is_keep) AS keep_path, CAST(sum(size) - max(size) FILTER (is_keep) AS BIGINT) AS reclaimable_bytes FROM mem GROUP BY group_id",
    "exact_group_members": f"WITH {EXACT} SELECT group_id, ord, path, is_keep, is_selected FROM mem",
    "exact_candidates_by_size": "SELECT CAST(strlen(text) AS BIGINT) AS size, count(*) AS n FROM documents WHERE strlen(text) > 0 GROUP BY 1 HAVING count(*) > 1",
    "partial_hash_buckets": "SELECT CAST(strlen(text) AS BIGINT) AS size, sha256(encode(text)[1:65536]) AS partial_hash, count(*) AS n FROM documents WHERE strlen(text) > 0 GROUP BY 1, 2 HAVING count(*) > 1",
    "exact_rows_lineitem": "SELECT l_partkey, l_quantity, l_tax, l_discount, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "order_line_keys": "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "hardlink_collapse": f"WITH {REC} SELECT path, inode FROM (SELECT *, row_number() OVER (PARTITION BY inode ORDER BY doc_id, path) AS k FROM rec) WHERE k = 1",
    "media_classes": f"WITH {REC} SELECT path, media_type, extension IN {STILL} AS still, pixels, stamp FROM recs",
    "duration_range_join": f"WITH {CONV}, d AS (SELECT DISTINCT duration AS v FROM sq WHERE duration > 0) SELECT CAST(a.v AS BIGINT) AS id_a, CAST(b.v AS BIGINT) AS id_b FROM d a JOIN d b ON a.v < b.v AND a.v >= 0.9 * b.v",
    "sequence_edges": f"""WITH {CONV}, s AS (SELECT duration, frames, min(id) AS id FROM sq WHERE frames IS NOT NULL GROUP BY duration, frames),
        p AS (
            SELECT a.id AS id_a, b.id AS id_b, a.frames AS fa, b.frames AS fb, least(len(a.frames), len(b.frames)) AS c FROM s a JOIN s b ON a.id < b.id
            WHERE (a.duration > 0 AND b.duration > 0 AND least(a.duration, b.duration) >= 0.9 * greatest(a.duration, b.duration)) OR NOT (a.duration > 0) OR NOT (b.duration > 0)),
        q AS (
            SELECT *, [CAST(bit_count(xor(fa[CASE WHEN c = 1 THEN 1 ELSE CAST(round_even(k * (len(fa) - 1) / (c - 1), 0) AS BIGINT) + 1 END], fb[CASE WHEN c = 1 THEN 1 ELSE CAST(round_even(k * (len(fb) - 1) / (c - 1), 0) AS BIGINT) + 1 END])) AS INTEGER) for k in range(0, c)] AS d FROM p)
        SELECT id_a, id_b FROM q WHERE bit_count(xor(fa[1], fb[1])) <= 52 AND bit_count(xor(fa[-1], fb[-1])) <= 52 AND list_max(d) <= 52 AND list_sum(d) <= 26 * len(d)""",
    "sample_timestamps": f"WITH {CONV}, n AS (SELECT id, duration / 100 AS d, least(8, greatest(3, least(8, CAST(trunc(duration / 100) AS BIGINT) + 1))) AS n FROM sq) SELECT id, CAST(n AS BIGINT) AS n, round((n - 1) * d / n, 6) AS last FROM n",
    "embedding_sign_edges": f"WITH {SIGN_EDGES} SELECT * FROM se",
    "similarity_eval": f"""WITH {SIGN_EDGES}, r AS (
            SELECT a.label = b.label AS t, CASE WHEN distance <> 13 THEN distance <= 14 END AS p FROM se JOIN sg a ON a.code = code_a JOIN sg b ON b.code = code_b),
        c AS (SELECT count(p) AS evaluated, count(*) - count(p) AS errors, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM r)
        SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fn, 0) AS negative_precision, (tp + tn) / nullif(evaluated, 0) AS accuracy FROM c""",
    "detector_eval": """WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        r AS (SELECT lang, toxic = 1 AS t, CASE WHEN doc_id % 10 <> 0 THEN contains(lower(text), 'idiot') OR contains(lower(text), 'stupid') END AS p FROM documents JOIN l USING (doc_id)),
        c AS (SELECT lang, count(p) AS evaluated, count(*) - count(p) AS errors, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM r GROUP BY lang)
        SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fn, 0) AS negative_precision, (tp + tn) / nullif(evaluated, 0) AS accuracy FROM c""",
    "detector_mistakes": """WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
        r AS (SELECT doc_id, toxic = 1 AS t, CASE WHEN doc_id % 10 <> 0 THEN contains(lower(text), 'idiot') OR contains(lower(text), 'stupid') END AS p FROM documents JOIN l USING (doc_id))
        SELECT doc_id, CASE WHEN t THEN 'false_negative' ELSE 'false_positive' END AS mistake FROM r WHERE t <> p""",
    "face_summary": f"WITH {REC} SELECT count(face_count) AS analyzed, count(*) FILTER (face_count >= 1) AS with_faces, count(*) FILTER (face_count > 1) AS with_several FROM rec",
    "no_human_group": f"""WITH {REC}, p AS (SELECT *, row_number() OVER (ORDER BY stamp DESC, path) AS ord FROM recs WHERE status = 'no_person_detected' AND string_split(signature, '|')[1] = '{HUMAN}')
        SELECT (SELECT substr(sha1('no_humans|' || string_agg(path, '|' ORDER BY path)), 1, 12) FROM p) AS group_id, ord, path FROM p""",
    "manual_override": f"""WITH {REC}, s AS (SELECT path, signature, CASE WHEN size > 2000 THEN 'person_confirmed' ELSE status END AS st FROM rec)
        SELECT path, st = 'no_person_detected' AND string_split(signature, '|')[1] = '{HUMAN}' AS no_person,
               st = 'person_confirmed' OR (signature = '{HUMAN}|opencv|0.4' AND st IN ('person_detected', 'no_person_detected')) AS reusable FROM s""",
    "low_res_group": f"WITH {REC} SELECT row_number() OVER (ORDER BY pixels, path) AS ord, path, pixels FROM recs WHERE media_type IN ('image', 'gif', 'video') AND pixels > 0 AND pixels < 1500",
    "low_res_per_type_bounds": f"WITH {REC} SELECT path, media_type FROM recs WHERE pixels > 0 AND ((media_type = 'image' AND pixels < 1000) OR (media_type = 'video' AND pixels < 3000))",
    "keep_decisions_antijoin": f"WITH {REC} SELECT path FROM recs WHERE face_count IS DISTINCT FROM 1 AND media_type = 'image' AND pixels > 0 AND pixels < 2500",
    "random_review_50": f"WITH {REC} SELECT path FROM rec ORDER BY md5('7:' || path), path LIMIT 50",
    "smart_select_deselect_all": f"WITH {EXACT} SELECT group_id, path, is_keep, FALSE AS is_selected FROM mem",
    "smart_select_select_candidates": f"WITH {EXACT} SELECT group_id, path, is_keep, is_selected FROM mem",
    "smart_select_review_groups": f"WITH {STATE} SELECT kind, path, is_reviewed AS is_selected FROM state WHERE kind <> 'exact'",
    "effective_selection": f"WITH {STATE} SELECT path, size FROM eff",
    "keep_veto": f"WITH {STATE} SELECT path FROM veto",
    "kind_precedence_counts": f"""WITH {STATE},
        px AS (SELECT m.path FROM mem m WHERE is_selected AND path NOT IN (SELECT path FROM veto)),
        f AS (
            SELECT path, 0 AS r, 'exact' AS kind FROM px UNION ALL
            SELECT path, 2, kind FROM state WHERE kind = 'no_humans' AND is_selected AND is_reviewed UNION ALL
            SELECT path, 3, kind FROM state WHERE kind = 'low_resolution' AND is_selected AND is_reviewed),
        g AS (SELECT f.*, row_number() OVER (PARTITION BY path ORDER BY r) AS k FROM f WHERE path IN (SELECT path FROM eff))
        SELECT kind, count(*) AS selected_count FROM g WHERE k = 1 GROUP BY kind""",
    "removal_routes": f"""WITH {STATE} SELECT CASE WHEN path IN (SELECT path FROM state WHERE kind = 'low_resolution' AND is_selected) THEN 'review_quarantine' ELSE 'trash' END AS route,
        count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM eff GROUP BY 1""",
    "bulk_select_all": f"WITH {STATE} SELECT kind, path, NOT is_keep AS is_selected, kind <> 'exact' AS is_reviewed FROM state",
    "bulk_select_none": f"WITH {STATE} SELECT kind, path, FALSE AS is_selected, is_reviewed FROM state",
    "bulk_invert": f"WITH {STATE} SELECT kind, path, NOT is_selected AND NOT is_keep AS is_selected, is_reviewed OR (kind <> 'exact' AND NOT is_selected) AS is_reviewed FROM state",
    "bulk_criteria": f"""WITH {STATE}, c AS (SELECT *, coalesce(size >= 300 AND size <= 4000 AND contains(lower(path), 'src1') AND face_count >= 1, FALSE) AND NOT is_keep AS hit FROM state)
        SELECT kind, path, hit AS is_selected, is_reviewed OR (kind <> 'exact' AND hit) AS is_reviewed FROM c""",
    "bulk_smaller_than_keeper": f"""WITH RECURSIVE {REC}, {CODES}, {PAIRS}, {clusters(False)}
        SELECT s.group_id, s.path, NOT s.is_keep AND s.size < k.size AS is_selected FROM sim s JOIN sim k ON k.group_id = s.group_id AND k.is_keep""",
    "reviewer_decisions": f"""WITH {EXACT}, d AS (SELECT *, coalesce(face_count NOT IN (1, 2), TRUE) AS hit FROM mem)
        SELECT group_id, path, hit AND NOT (is_keep AND bool_and(hit) OVER (PARTITION BY group_id)) AS is_selected FROM d""",
    "reclaimable_by_group": f"""WITH {STATE} SELECT kind, count(*) AS member_count, CAST(CASE WHEN kind = 'exact' THEN sum(size) - max(CASE WHEN is_keep THEN size END)
        ELSE sum(CASE WHEN is_selected AND is_reviewed THEN size ELSE 0 END) END AS BIGINT) AS reclaimable_bytes FROM state GROUP BY group_id, kind""",
    "scan_stats": f"""WITH {STATE} SELECT count(DISTINCT group_id) FILTER (kind = 'exact') AS exact_groups, CAST(0 AS BIGINT) AS similar_groups, count(*) FILTER (kind = 'no_humans') AS no_human_files,
        count(*) FILTER (kind = 'low_resolution') AS low_resolution_files, CAST(0 AS BIGINT) AS random_review_files, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM eff) AS reclaimable_bytes, (SELECT count(*) FROM eff) AS selected_count FROM state""",
    "stage_diagnostics": f"""WITH {REC}, {CODES}, r AS (SELECT r.*, phash FROM rec r LEFT JOIN fp USING (doc_id)),
        s AS (
            SELECT 'exact' AS stage, size > 0 AS a, TRUE AS d FROM r UNION ALL SELECT 'image_hash', media_type IN ('image', 'gif'), phash IS NOT NULL FROM r UNION ALL
            SELECT 'dimensions', media_type IN ('image', 'gif', 'video'), coalesce(width > 0 AND height > 0, FALSE) FROM r UNION ALL
            SELECT 'person', media_type IN ('image', 'gif', 'video'), status <> 'analysis_failed' FROM r UNION ALL SELECT 'faces', media_type IN ('image', 'gif'), face_count IS NOT NULL FROM r)
        SELECT stage, count(*) FILTER (a) AS attempted, count(*) FILTER (a AND d) AS succeeded, count(*) FILTER (a AND NOT d) AS failed, count(*) FILTER (NOT a) AS skipped FROM s GROUP BY stage""",
    "first_errors": f"WITH {REC} SELECT error, min(doc_id) AS first FROM rec WHERE error IS NOT NULL GROUP BY error ORDER BY 2 LIMIT 20",
    "group_media_types": f"""WITH {EXACT}, c AS (SELECT group_id, media_type, count(*) AS n, min(ord) AS o FROM mem GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, o) AS i FROM c)
        SELECT group_id, max(media_type) FILTER (i = 1) AS dominant, CASE WHEN count(*) = 1 THEN max(media_type) ELSE 'mixed' END AS single FROM k GROUP BY group_id""",
    "cache_hydrate": f"WITH {REC}, {CACHE} SELECT r.path, coalesce(h.sha, r.sha256) AS sha256, CAST(coalesce(h.faces, r.face_count) AS INTEGER) AS face_count, h.path IS NOT NULL AS from_cache FROM rec r LEFT JOIN hit h USING (path)",
    "cache_rename_hits": f"WITH {REC}, {CACHE} SELECT path, cached_path FROM hit WHERE path <> cached_path",
    "cache_upsert": f"WITH {REC}, {CACHE} SELECT path, size, sha256, 'v2' AS algorithm_version FROM rec UNION ALL SELECT path, size, sha, ver FROM cac WHERE path NOT IN (SELECT path FROM rec)",
    "cacheable_rows": f"""WITH {REC}, {CODES} SELECT path, phash IS NOT NULL OR dhash IS NOT NULL OR coalesce(width > 0 AND height > 0, FALSE) OR status IN ('person_detected', 'no_person_detected') AS cacheable,
        phash IS NULL OR dhash IS NULL AS needs_codes FROM rec LEFT JOIN fp USING (doc_id)""",
    "distinct_pair_revalidate": f"WITH {EXACT} SELECT DISTINCT a.path AS path_a, b.path AS path_b FROM mem a JOIN mem b ON a.group_id = b.group_id AND a.path < b.path WHERE coalesce(a.face_count <> 3, TRUE) AND coalesce(b.face_count <> 3, TRUE)",
    "group_listing_filtered": f"""WITH {STATE}, s AS (
            SELECT group_id, CAST(count(*) FILTER (is_selected) AS BIGINT) AS selected, count(*) FILTER (is_selected) >= count(*) - 1 AS complete, count(error) > 0 AS issue,
                   CASE WHEN count(DISTINCT media_type) = 1 THEN min(media_type) ELSE 'mixed' END AS media_type, bool_or(size >= 0.0005 * 1048576 AND regexp_matches(path, '(?i)src1.*doc')) AS hit
            FROM state WHERE kind = 'exact' GROUP BY group_id)
        SELECT group_id, selected, complete, issue OR NOT complete AS needs_attention, media_type FROM s WHERE hit""",
    "group_listing_page": f"WITH {EXACT} SELECT group_id, CAST(sum(size) - max(size) FILTER (is_keep) AS BIGINT) AS reclaimable_bytes FROM mem GROUP BY group_id ORDER BY 2 DESC, group_id LIMIT 10 OFFSET 5",
    "group_listing_by_members": f"""WITH {EXACT}, g AS (SELECT group_id, count(*) AS member_count, sum(size) - max(size) FILTER (is_keep) AS r FROM mem GROUP BY group_id)
        SELECT group_id, member_count FROM g ORDER BY member_count DESC, r DESC, group_id LIMIT 20""",
    "group_tab_counts": f"WITH {STATE} SELECT kind, count(DISTINCT group_id) AS groups, count(*) AS members FROM state GROUP BY kind",
    "group_neighbours": f"""WITH {EXACT}, g AS (SELECT group_id, sum(size) - max(size) FILTER (is_keep) AS r FROM mem GROUP BY group_id)
        SELECT group_id, lag(group_id) OVER w AS previous, lead(group_id) OVER w AS next FROM g WINDOW w AS (ORDER BY r DESC, group_id)""",
    "record_path_parts": f"""WITH {REC} SELECT path, 'doc' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS stem, extension AS suffix, CAST(depth AS BIGINT) AS depth,
        root = '/src1' OR starts_with(path, '/src2/de/') AS in_roots, FALSE AS in_package FROM recs""",
    "exclusion_globs": f"""WITH {REC} SELECT path, regexp_full_match(lower(path), '/src1.*/en/.*') OR regexp_full_match(string_split(path, '/')[-1], 'doc0000001.\\..*') OR regexp_full_match(path, '.*[13579]\\.gif') AS excluded, FALSE AS hidden FROM rec""",
    "path_matcher": f"WITH {REC} SELECT path, contains(lower(path), 'src1/') AS plain, regexp_matches(path, '(?i)src./d.*7.gif') AS pattern, TRUE AS empty FROM rec",
    "prune_reasons": f"""WITH {REC}, {NOW}, {checked(True)} SELECT CASE WHEN contains(error, 'symbolic link') THEN 'symlink' WHEN contains(error, 'no longer exists') OR contains(error, 'No such file') THEN 'missing' WHEN contains(error, 'outside the scanned roots') THEN 'outside_roots'
        WHEN contains(error, 'changed since scan') THEN 'changed' ELSE 'unreadable' END AS reason, count(*) AS n, min(path) AS sample FROM chk WHERE error IS NOT NULL GROUP BY 1""",
    "receipts_list": f"WITH {RCP} SELECT id, action FROM rcp WHERE NOT dry_run ORDER BY started_at DESC, id DESC LIMIT 25",
    "receipts_prune": f"""WITH {RCP}, k AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS k FROM rcp),
        p AS (SELECT id, CASE WHEN dry_run THEN 'dry-run preview' WHEN k > 500 THEN 'outside the 500 newest receipts' WHEN started_at < TIMESTAMP '2024-01-11 00:00:00' THEN 'older than 20 days' END AS reason FROM k)
        SELECT id, reason FROM p WHERE reason IS NOT NULL""",
    "receipts_totals": f"WITH {RCP} SELECT id, CAST(1 AS BIGINT) AS items, CAST(ok AS BIGINT) AS ok, CAST(NOT ok AS BIGINT) AS failed, CASE WHEN ok THEN size ELSE 0 END AS bytes, NOT dry_run AND action = 'quarantine' AND ok AND dest AS undoable FROM rcp",
    "receipt_reference": f"WITH {RCP} SELECT id, CAST(4 AS BIGINT) AS tier FROM rcp WHERE contains(id, '0000000012')",
    "lru_budget_prune": """WITH f AS (SELECT CAST(event_id AS VARCHAR) AS path, CAST(floor(value * 100) AS BIGINT) AS size, ts FROM events),
        r AS (SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY ts, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM f)
        SELECT path FROM r WHERE total - gone > 20000000""",
    "validate_identity": f"WITH {REC}, {NOW}, {checked(True)} SELECT path, error FROM chk",
    "preflight": f"WITH {PREFLIGHT} SELECT path, error FROM pre WHERE error IS NOT NULL",
    "action_plan": f"WITH {PREFLIGHT} SELECT path, group_id, ok, destination, error FROM pln",
    "isolate_names": f"""WITH {EXACT}, c AS (SELECT group_id, media_type, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(ord)) AS k FROM mem GROUP BY 1, 2),
        g AS (SELECT group_id, sum(size) - max(size) FILTER (is_keep) AS r, count(*) AS n, max(regexp_extract(path, '([^/]*)\\.[^./]*$', 1)) FILTER (is_keep) AS stem FROM mem GROUP BY group_id),
        f AS (SELECT group_id, printf('/review/exact/%03d_exact_%s_n%d_%s_%s', row_number() OVER (ORDER BY r DESC, group_id), media_type, n, substr(stem, 1, 40), group_id) AS folder FROM g JOIN c USING (group_id) WHERE k = 1)
        SELECT path, folder || '/' || CASE WHEN is_keep THEN 'KEEP__' ELSE '' END || string_split(path, '/')[-1] AS destination FROM mem JOIN f USING (group_id)""",
    "session_prune": f"""WITH {EXACT}, {NOW}, {checked(False)},
        l AS (SELECT m.*, count(*) OVER (PARTITION BY group_id) AS left_n, max(CAST(is_keep AS INTEGER)) OVER (PARTITION BY group_id) AS has, min(ord) OVER (PARTITION BY group_id) AS first
              FROM mem m JOIN chk USING (path) WHERE chk.error IS NULL),
        k AS (SELECT *, CASE WHEN has = 1 THEN is_keep ELSE ord = first END AS keep FROM l WHERE left_n >= 2)
        SELECT group_id, path, keep AS is_keep, is_selected AND NOT keep AS is_selected FROM k""",
    "progress_eta": "WITH e AS (SELECT event_id, event_id % 100 AS done, value FROM events), r AS (SELECT *, CASE WHEN done > 0 AND value > 0 THEN done / value END AS rate FROM e) SELECT event_id, round(rate, 6) AS rate, round((100 - done) / rate, 6) AS eta FROM r",
    "preview_verdicts": "SELECT CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN 300 > event_id % 600 THEN 'expired' WHEN event_id % 3 = 0 THEN 'changed' ELSE 'valid' END AS verdict, count(*) AS n FROM events GROUP BY 1",
    "code_distances": f"WITH {CODES} SELECT doc_id, CAST(bit_count(xor(phash, dhash)) AS BIGINT) AS distance FROM fp",
    "events_once_per_user": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
    "scan_kinds": f"""WITH {STATE} SELECT kind, count(DISTINCT group_id) AS groups, count(*) AS members FROM state GROUP BY kind
        UNION ALL SELECT 'random_review', 1, least(25, count(*)) FROM rec HAVING count(*) > 0""",
    "similar_video_clusters": f"""WITH RECURSIVE {CONV},
        pool AS (SELECT '/c/' || lpad(CAST(id AS VARCHAR), 8, '0') AS path, duration, frames, row_number() OVER (ORDER BY CAST(duration AS BIGINT) DESC, '/c/' || lpad(CAST(id AS VARCHAR), 8, '0') DESC) AS k FROM sq WHERE frames IS NOT NULL),
        p AS (
            SELECT a.k AS ka, b.k AS kb, a.frames AS fa, b.frames AS fb, least(len(a.frames), len(b.frames)) AS c FROM pool a JOIN pool b ON a.k < b.k
            WHERE (a.duration > 0 AND b.duration > 0 AND least(a.duration, b.duration) >= 0.9 * greatest(a.duration, b.duration)) OR NOT (a.duration > 0) OR NOT (b.duration > 0)),
        q AS (
            SELECT *, [CAST(bit_count(xor(fa[CASE WHEN c = 1 THEN 1 ELSE CAST(round_even(i * (len(fa) - 1) / (c - 1), 0) AS BIGINT) + 1 END], fb[CASE WHEN c = 1 THEN 1 ELSE CAST(round_even(i * (len(fb) - 1) / (c - 1), 0) AS BIGINT) + 1 END])) AS INTEGER) for i in range(0, c)] AS d FROM p),
        near AS (SELECT ka, kb FROM q WHERE bit_count(xor(fa[1], fb[1])) <= 52 AND bit_count(xor(fa[-1], fb[-1])) <= 52 AND list_max(d) <= 52 AND list_sum(d) <= 26 * len(d)), {clusters(False)}
        SELECT group_id, path, is_keep FROM sim""",
    "errors_by_stage": """WITH e AS (SELECT ['sha256 failed: a', 'partial hash failed: b', 'image hash failed: c', 'video fingerprint failed: d', 'image hash: e'][doc_id % 5 + 1] AS error FROM documents WHERE doc_id % 3 = 0),
        s AS (SELECT CASE WHEN starts_with(error, 'sha256 failed') OR starts_with(error, 'partial hash failed') THEN 'exact' WHEN starts_with(error, 'image hash failed') THEN 'similar_image' WHEN starts_with(error, 'video fingerprint failed') THEN 'similar_video' END AS stage, error FROM e)
        SELECT stage, count(*) AS errors, min(error) AS sample FROM s WHERE stage IS NOT NULL GROUP BY stage""",
    "event_throughput": "SELECT event_type, count(*) AS items, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS elapsed_seconds, count(*) / nullif(sum(CAST(floor(value) AS BIGINT)), 0) AS items_per_second FROM events GROUP BY event_type",
    "scanned_totals": f"WITH {REC} SELECT media_type, count(*) AS files_found, CAST(sum(size) AS BIGINT) AS bytes_scanned FROM rec GROUP BY media_type",
    "receipts_freed": f"""WITH {RCP}, k AS (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS k FROM rcp)
        SELECT count(*) FILTER (k <= 500) AS kept_count, CAST(coalesce(sum(size) FILTER (k > 500), 0) AS BIGINT) AS freed_bytes FROM k""",
    "one_group": f"WITH {STATE} SELECT o AS ord, path, doc_id % 3 = 0 AS deleted FROM low",
    "bulk_in_view": f"""WITH {STATE}, v AS (SELECT DISTINCT group_id FROM mem WHERE contains(lower(path), '/src1/'))
        SELECT kind, path, is_selected AND NOT coalesce(kind = 'exact' AND group_id IN (SELECT group_id FROM v), FALSE) AS is_selected FROM state""",
    "allowed_paths": f"WITH {REC} SELECT path, doc_id % 4 = 0 AS allowed FROM rec WHERE doc_id % 2 = 0 UNION ALL SELECT '/other' || path, FALSE FROM rec WHERE doc_id % 5 = 0",
    "deleted_candidates_undo": f"WITH {STATE} SELECT '/trash' || min(path) AS source, min(path) AS destination, CAST(NULL AS VARCHAR) AS error FROM ppl HAVING count(*) > 0",
    "code_explanations": f"WITH {CODES} SELECT doc_id, nullif(concat_ws(', ', 'pHash distance ' || CAST(bit_count(xor(phash, dhash)) AS VARCHAR), 'dHash distance ' || CAST(bit_count(xor(dhash, dhash)) AS VARCHAR)), '') AS text FROM fp",
    "display_formats": f"""WITH {REC} SELECT path, CASE WHEN size >= 3600 THEN printf('%d:%02d:%02d', size // 3600, size // 60 % 60, size % 60) ELSE printf('%d:%02d', size // 60, size % 60) END AS duration,
        CASE extension WHEN '.jpg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END AS mime FROM rec""",
}
for _rule in _rule_order:
    SQL[f"smart_select_{_rule}"] = f"WITH {EXACT}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_rule_order[_rule]}, ord) = 1 AS best FROM mem) SELECT group_id, path, best AS is_keep, NOT best AS is_selected FROM k"
