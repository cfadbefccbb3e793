"""DuckDB SQL for the corpus queries that SQL can express."""

from . import chat, mixing, url_filters

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op1() -> str:
    hosts = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{a}')" for r, a in url_filters.HOST_RULES)
    globs = "".join(f" WHEN host || translate(path, '{_UP}', '{_LOW}') LIKE '%{g.strip('*')}%' THEN '{g}'" for g, _ in url_filters.GLOBS)
    return f"""
WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
                      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts),
     rules(rule_host, rule_path, rule, verdict) AS (VALUES {hosts}),
     fits AS (SELECT s.*, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC NULLS LAST) AS k
              FROM split s LEFT JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN CASE{globs} END IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN CASE{globs} END END AS pattern
FROM fits WHERE k = 1"""


_OP9 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS s FROM documents),
     g AS (SELECT *, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(s) AS text_sha256 FROM g"""


def _op10(own: str) -> str:
    mark = lambda k: f"CASE role WHEN 'user' THEN {len(chat.MARKS['user'][k])} WHEN 'assistant' THEN {len(chat.MARKS['assistant'][k])} WHEN 'system' THEN {len(chat.MARKS['system'][k])} ELSE {len(chat.OTHER[k])}{'' if k else ' + coalesce(length(' + _escaped('role') + ') + 3, 0)'} END"
    return f"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '{own}'), (-7, 1, 'assistant', '{own}')),
     runs AS (SELECT *, {_escaped("text")} AS said, row_number() OVER w AS k, lag(role) OVER w AS before FROM turns
              WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
     sized AS (SELECT *, length(said) + CASE WHEN k = 1 OR role IS DISTINCT FROM before THEN {mark(0)} + {mark(1)} ELSE 3 END AS chars FROM runs)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def _escaped(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*(?:/?INST|/?SYS|/?ROLE|:|\+)\])', '[\\\1', 'g')"


def _seeded(seed: str, *cols: str) -> str:
    said = " || ':' || ".join([f"'{seed}'", *[f"coalesce({c}::VARCHAR, 'null')" for c in cols]])
    return f"('0x' || substr(md5({said}), 1, 13))::BIGINT"


def _lague(src: str, key: str, weight: str, seats: str, by: str, name: str) -> str:
    """Every quotient down to the seats' number in its group, ranked; the highest win."""
    over = f"PARTITION BY {by}" if by else ""
    group = f"{by}, {key}" if by else key
    return f"""{name}_quotients AS (SELECT {group}, {seats} AS seats, {weight} / (2 * k + 1) AS quotient, k
       FROM (SELECT *, sum({weight}) OVER ({over}) AS mass, count(*) OVER ({over}) AS m FROM {src}) q,
            range(greatest(0, CASE WHEN mass > 0 AND {seats} - m / 2 > 0 THEN floor({weight} * ({seats} - m / 2) / mass + 0.5) ELSE 0 END - 2)::BIGINT,
                  CASE WHEN {weight} > 0 THEN floor({weight} * ({seats} + m / 2) / mass + 0.5) + 2 ELSE 0 END::BIGINT) r(k)),
     {name}_base AS (SELECT {group}, min(k) AS base, min(seats) AS seats FROM {name}_quotients GROUP BY ALL),
     {name}_left AS (SELECT *, seats - sum(base) OVER ({over}) AS left_over FROM {name}_base),
     {name}_won AS (SELECT {group}, count(*) AS won FROM (SELECT q.*, l.left_over, row_number() OVER ({over.replace("BY ", "BY q.")} ORDER BY quotient DESC, q.{key} NULLS LAST, k) AS place
       FROM {name}_quotients q JOIN {name}_left l ON {" AND ".join(f"q.{c} IS NOT DISTINCT FROM l.{c}" for c in group.split(", "))}) WINDOWED WHERE place <= left_over GROUP BY ALL),
     {name} AS (SELECT s.*, coalesce(l.base, 0) + coalesce(w.won, 0) AS quota_{name} FROM {src} s
       LEFT JOIN {name}_left l ON {" AND ".join(f"s.{c} IS NOT DISTINCT FROM l.{c}" for c in group.split(", "))}
       LEFT JOIN {name}_won w ON {" AND ".join(f"s.{c} IS NOT DISTINCT FROM w.{c}" for c in group.split(", "))})"""


def op8(documents: str = "documents") -> str:
    b, seed, most = mixing.BLOCK_WORDS, mixing.SEED, mixing.MAX_REPEATS
    return f"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, {_seeded(str(seed), "doc_id")} AS hash FROM {documents}),
     named AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM docs GROUP BY source),
     capped AS (SELECT *, {most} * source_size AS cap, sum(source_size) OVER () AS total FROM named),
     levels AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level FROM capped
                WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     targets AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target, round(total::DOUBLE / {b})::BIGINT AS blocks,
                        least({mixing.MAX_SHARDS}, ceil(n_rows / {mixing.SHARD_ROWS}))::BIGINT AS n_shards FROM levels),
     {_lague("targets", "source", "target", "blocks", "", "sources")},
     dealt AS (SELECT d.*, s.source_size, s.target, s.quota_sources, d.hash % s.n_shards AS shard FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
     rings AS (SELECT source, shard, quota_sources, sum(size)::BIGINT AS ring, sum(size)::DOUBLE AS mass_of FROM dealt GROUP BY ALL),
     {_lague("rings", "shard", "mass_of", "quota_sources", "source", "shards")},
     laid AS (SELECT d.*, r.ring, least(r.quota_shards * {b}, {most} * r.ring)::BIGINT AS words,
                     (sum(d.size) OVER (PARTITION BY d.source, d.shard ORDER BY d.hash, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS past
              FROM dealt d JOIN shards r ON d.source IS NOT DISTINCT FROM r.source AND d.shard = r.shard),
     cut AS (SELECT *, past - size AS lo, words // greatest(ring, 1) AS copies, words - (words // greatest(ring, 1)) * ring AS rest,
                    CASE WHEN ring > 0 THEN {_seeded(str(seed + 1), "source", "shard")} % ceil(ring / {b})::BIGINT * {b} ELSE 0 END AS start FROM laid)
SELECT doc_id, size, source_size, target,
       (copies * size + greatest(0, least(past, start + rest) - greatest(lo, start)) + greatest(0, least(past, start + rest - ring) - lo))::BIGINT AS taken
FROM cut"""


_OP2 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""


ORACLES = {
    "op1_url_filters": _op1(),
    "op2_warc": _OP2,
    "op8_mixing": op8(),
    "op9_exact_dedup": _OP9,
    "op10_chat_formatting": _op10("</s>[INST] ok [/INST]"),
}
