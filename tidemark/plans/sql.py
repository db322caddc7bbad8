"""Pieces of the SQL that queries are checked against."""

from __future__ import annotations

from ..config import AUTHORITY, NOW, SUGGESTIONS
from ..functions import text as T
from . import samples

HEX = "'0123456789abcdef'"


def tok(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '{T.TOKEN}')"


MEM = f"""mem AS (
  SELECT d.doc_id AS record_id, CASE lang WHEN 'en' THEN 'fact' WHEN 'de' THEN 'decision' WHEN 'fr' THEN 'episode' ELSE 'code' END AS kind, text, source,
    source || '-' || (d.doc_id % 25) AS subject, CASE WHEN d.doc_id = min(d.doc_id) OVER (PARTITION BY text) THEN 'active' ELSE 'superseded' END AS status,
    CASE WHEN l.quality = 1 THEN 0.9 WHEN l.quality = 0 THEN 0.5 ELSE (CASE lang WHEN 'en' THEN {AUTHORITY['fact']} WHEN 'de' THEN {AUTHORITY['decision']} WHEN 'fr' THEN {AUTHORITY['episode']} ELSE {AUTHORITY['code']} END) END::DOUBLE AS authority,
    (d.doc_id % 400)::DOUBLE AS age, source || '-' || (d.doc_id % 25) || chr(10) || chr(10) || text AS indexed
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


def bm25(source: str, id_: str, text: str, keep: str = "true", k: int = 24, name: str = "lex") -> str:
    """CTEs up to ``name`` (query_id, chunk_id, score, rank) for the benchmark's texts."""
    return f"""bt AS (SELECT {id_} AS chunk_id, ({keep}) AS kept, {tok(text)} AS t FROM {source}),
bs AS (SELECT count(*)::DOUBLE AS n, sum(len(t))::DOUBLE / count(*) AS avgdl FROM bt),
btf AS (SELECT chunk_id, kept, dl, token, count(*) AS tf FROM (SELECT chunk_id, kept, len(t) AS dl, unnest(t) AS token FROM bt) GROUP BY ALL),
bdf AS (SELECT token, count(*) AS df FROM btf GROUP BY token),
bq AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS token FROM benchmark) GROUP BY ALL),
bsc AS (SELECT query_id, chunk_id, round(sum(qtf * (ln(1.0::DOUBLE + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))))), 6) AS score
  FROM bq JOIN btf USING (token) JOIN bdf USING (token), bs WHERE kept GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bsc WHERE score > 0) WHERE rank <= {k})"""


def hashed(name: str, source: str, id_: str, text: str) -> str:
    return f"""{name} AS (SELECT id, dim, sum(x)::DOUBLE AS val FROM (
  SELECT id, (strpos({HEX}, m[1]) - 1) * 16 + strpos({HEX}, m[2]) - 1 AS dim, CASE WHEN (strpos({HEX}, m[3]) - 1) % 2 = 0 THEN 1 ELSE -1 END AS x
  FROM (SELECT id, md5(token) AS m FROM (SELECT {id_} AS id, unnest({tok(text)}) AS token FROM {source}))) GROUP BY id, dim HAVING sum(x) <> 0)"""


def hashed_top(source: str, id_: str, text: str, k: int = 24, name: str = "den") -> str:
    """CTEs up to ``name`` for the benchmark's hashed vectors against those of ``source``."""
    return f"""{hashed('hq', 'benchmark', 'item_id', 'text')},
{hashed('hd', source, id_, text)},
hp AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.val * d.val) AS dot FROM hq q JOIN hd d USING (dim) GROUP BY ALL),
hn AS (SELECT q.id AS query_id, d.id AS chunk_id, q.n AS qn, d.n AS dn FROM (SELECT id, sqrt(sum(val * val)) AS n FROM hq GROUP BY id) q, (SELECT id, sqrt(sum(val * val)) AS n FROM hd GROUP BY id) d),
hs AS (SELECT query_id, chunk_id, round(coalesce(dot, 0) / (qn * dn), 6) + 0.0 AS score FROM hn LEFT JOIN hp USING (query_id, chunk_id)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hs) WHERE rank <= {k})"""


def rrf(top: int, wd: float = 1.0, wb: float = 1.0, cut: int = 24) -> str:
    return f"""u AS (SELECT query_id, chunk_id, {wd}::DOUBLE / (60 + rank) AS part, rank AS pos FROM den WHERE rank <= {cut} UNION ALL SELECT query_id, chunk_id, {wb}::DOUBLE / (60 + rank), 1000000 + rank FROM lex WHERE rank <= {cut}),
f AS (SELECT query_id, chunk_id, round(sum(part), 9) AS score, min(pos) AS first FROM u GROUP BY ALL),
r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, score, rank, 'hybrid' AS origin FROM r WHERE rank <= {top}"""


EVIDENCE = f"""{MEM}, act AS (SELECT * FROM mem WHERE status = 'active'),
{bm25('mem', 'record_id', 'indexed', "status = 'active'")},
{hashed_top('act', 'record_id', 'indexed')},
em AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS record_id,
  round(greatest(coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, d.score)), 0), coalesce(b.score / (b.score + 4.0::DOUBLE), 0)), 6) AS similarity, d.query_id IS NOT NULL AS in_dense, b.query_id IS NOT NULL AS in_bm25
  FROM den d FULL JOIN lex b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
ev AS (SELECT e.*, kind, subject, authority, age FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, record_id) - 1 AS rank FROM em) e JOIN mem USING (record_id) WHERE rank < 12)"""

CLASH = """c0 AS (SELECT query_id, record_id, lower(subject) AS subject, first_value(record_id) OVER (PARTITION BY query_id, lower(subject) ORDER BY rank) AS fid FROM ev WHERE rank < 6 AND kind IN ('fact', 'decision')),
clash AS (SELECT DISTINCT query_id, subject FROM c0 WHERE record_id <> fid)"""

SIGNALS = f"""{EVIDENCE}, {CLASH},
g AS (SELECT query_id, max(similarity) FILTER (WHERE rank = 0) AS top, avg(similarity) FILTER (WHERE rank < 3) AS mean, least(1.0::DOUBLE, count(*) FILTER (WHERE similarity >= 0.35)::DOUBLE / 3) AS sources,
  CASE WHEN bool_or(in_dense) AND bool_or(in_bm25) THEN (count(*) FILTER (WHERE rank < 4 AND in_dense AND in_bm25))::DOUBLE / count(*) FILTER (WHERE rank < 4) ELSE 0.5 END AS agree,
  avg(pow(0.5::DOUBLE, age / CASE kind WHEN 'fact' THEN 180.0 WHEN 'decision' THEN 365.0 WHEN 'episode' THEN 30.0 ELSE 21.0 END)) FILTER (WHERE rank < 3) AS recent, avg(authority) FILTER (WHERE rank < 3) AS auth, count(*) AS n_evidence FROM ev GROUP BY query_id),
s0 AS (SELECT b.item_id AS query_id, g.* EXCLUDE (query_id), k.query_id IS NOT NULL AS conflict FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id LEFT JOIN (SELECT DISTINCT query_id FROM clash) k ON k.query_id = b.item_id),
s1 AS (SELECT *, coalesce(round((0.3::DOUBLE * least(1.0::DOUBLE, top) + 0.15::DOUBLE * sources + 0.15::DOUBLE * agree + 0.1::DOUBLE * recent + 0.15::DOUBLE * auth + 0.15::DOUBLE * CASE WHEN conflict THEN 0 ELSE 1 END) * least(1.0::DOUBLE, top / 0.35::DOUBLE), 4), 0) AS score FROM s0)"""
MODE = "CASE WHEN conflict THEN 'ask_clarification' WHEN score >= 0.7 THEN 'direct' WHEN score >= 0.5 THEN 'cautious' WHEN score >= 0.2 THEN 'search_more' ELSE 'refuse_guess' END"
NOW_TS = f"TIMESTAMP '{NOW}'"


def redacted(c: str) -> str:
    for pattern, by in T.SECRETS:
        for i in (1, 2, 3):
            by = by.replace(f"${i}", f"\\{i}")
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return c


SECRET = " OR ".join("regexp_matches(coalesce(text, ''), '{}')".format(p.replace("'", "''")) for p, _ in T.SECRETS)

_JACCARD = "len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
_AGE = "CASE WHEN age < 1 THEN 'today' WHEN age < 60 THEN age::BIGINT || 'd' ELSE (age::BIGINT // 30) || 'mo' END"
#: Greedy packing of ``ev``, rank by rank; needs WITH RECURSIVE.
PACKED = f"""items AS (SELECT ev.query_id, rank, similarity, first_value(similarity) OVER (PARTITION BY ev.query_id ORDER BY rank) AS best, list_distinct({tok('m.text')}) AS toks,
  '- [' || ev.kind || '|sim ' || printf('%.2f', similarity) || '|' || {_AGE.replace('age', 'ev.age')} || CASE WHEN coalesce(m.source, '') <> '' THEN '|' || m.source ELSE '' END || '] ' || CASE WHEN coalesce(ev.subject, '') <> '' THEN ev.subject || ': ' ELSE '' END || m.text AS line FROM ev JOIN mem m USING (record_id)),
fold AS (SELECT DISTINCT query_id, -1::BIGINT AS pos, 0::BIGINT AS spent, 0::BIGINT AS used, false AS cut, false AS done, []::VARCHAR[] AS lines, []::VARCHAR[][] AS sets FROM items
  UNION ALL SELECT query_id, rank, CASE WHEN skip THEN spent ELSE spent + greatest(1, (length(said) + 3) // 4) END, CASE WHEN skip THEN used ELSE used + 1 END, cut OR (NOT over AND NOT again AND too_long), over,
    CASE WHEN skip THEN lines ELSE list_append(lines, said) END, CASE WHEN skip THEN sets ELSE list_append(sets, toks) END
  FROM (SELECT *, CASE WHEN too_long THEN substr(line, 1, 7984) ELSE line END AS said, over OR again OR (too_long AND used > 0) AS skip
    FROM (SELECT f.*, x.rank, x.line, x.toks, f.done OR (x.similarity < x.best * 0.3::DOUBLE AND f.used > 0) AS over, f.spent + greatest(1, (length(x.line) + 3) // 4) > 2000 AS too_long,
        len(list_filter(f.sets, lambda o: CASE WHEN len(o) = 0 OR len(x.toks) = 0 THEN false ELSE {_JACCARD.format(a='x.toks', b='o')} >= 0.85::DOUBLE END)) > 0 AS again
      FROM fold f JOIN items x ON x.query_id = f.query_id AND x.rank = f.pos + 1))),
packed AS (SELECT query_id, array_to_string(lines, chr(10)) AS context, used, spent AS tokens, cut AS truncated FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1)"""
SUGGESTION = "CASE mode " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in SUGGESTIONS.items()) + " END"
SEARCH_WORDS = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')[1:12], ' ')"


def _template(text: str) -> str:
    """An SQL expression of one of the code templates."""
    out = text.replace("'", "''").replace("{{", "\0").replace("}}", "\1").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    for k, c in {"source": "source", "id": "doc_id", "n": "n_chars", "lang": "lang"}.items():
        out = out.replace("{" + k + "}", f"' || {c} || '")
    return "'" + out.replace("\0", "{").replace("\1", "}") + "'"


def _by_lang(values: dict[str, str]) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items() if k) + f" ELSE {values['']} END"


CODE = f"code AS (SELECT doc_id, lang, source, n_chars, source || '/' || doc_id || '.' || {_by_lang({k: repr(v) for k, v in samples.SUFFIX.items()} | {'': repr('go')})} AS file, {_by_lang({k: _template(v) for k, v in samples.TEXT.items()})} AS text FROM documents)"
LANGUAGE = _by_lang({"en": "'python'", "de": "'javascript'", "fr": "'rust'", "": "'go'"})
#: What each language's template declares: symbol, type, line, route and snippet.
SYMBOLS = """sym AS (
  SELECT file, 0 AS place, 'read_' || doc_id AS symbol, 'function' AS symbol_type, 5::BIGINT AS line, 'GET /doc/' || doc_id AS route, 'def read_' || doc_id || '():' AS snippet FROM code WHERE lang = 'en'
  UNION ALL SELECT file, 1, 'Doc' || doc_id, 'class', 9, NULL, 'class Doc' || doc_id || ':' || chr(10) || lang FROM code WHERE lang = 'en'
  UNION ALL SELECT file, 2, 'Doc' || doc_id || '.size', 'method', 12, NULL, 'def size(self):' FROM code WHERE lang = 'en'
  UNION ALL SELECT file, 0, 'read_' || doc_id, 'symbol', 3, NULL, 'function read_' || doc_id || '(x) {' FROM code WHERE lang = 'de'
  UNION ALL SELECT file, 1, 'size_' || doc_id, 'function', 2, NULL, 'export const size_' || doc_id || ' = (x) => x' FROM code WHERE lang = 'de'
  UNION ALL SELECT file, 0, 'read_' || doc_id, 'symbol', 2, NULL, 'fn read_' || doc_id || '(p: i32) -> i32 { p }' FROM code WHERE lang = 'fr'
  UNION ALL SELECT file, 0, 'Read' || doc_id, 'symbol', 2, NULL, 'func Read' || doc_id || '() int {' FROM code WHERE lang NOT IN ('en', 'de', 'fr'))"""
