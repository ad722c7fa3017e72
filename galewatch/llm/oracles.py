"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .infilling import MARKS
from .reply_trees import END, HEAD
from .url_filters import DAMPING, FLOOR, OUTWEIGH, ROUNDS, RULES

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_GROUPS = f"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce((SELECT n FROM n WHERE n.doc_id = r.doc_id), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r GROUP BY doc_id
"""


def _parts(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://(.*)$', 1)"
    host = f"regexp_extract({rest}, '(?s)^([^/?#]*)', 1)"
    low = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract(substr({rest}, length({host}) + 1), '(?s)^([^?#]*)', 1)"
    return f"coalesce({low}, '') AS host, coalesce({path}, '') AS path"


def _walk(name: str, edges: str, verdict: str) -> str:
    """One common table expression for each round of the propagation."""
    made = [f"{name}_base AS (SELECT host, sum(weight) / (SELECT sum(weight) FROM seeds) * {1 - DAMPING} AS part FROM seeds WHERE verdict = '{verdict}' GROUP BY host)"]
    made.append(f"{name}_0 AS (SELECT host, part AS rank FROM {name}_base)")
    for k in range(1, ROUNDS + 1):
        made.append(
            f"{name}_{k} AS (SELECT host, sum(part) AS rank FROM (SELECT host, part FROM {name}_base UNION ALL "
            f"SELECT e.dst, r.rank * e.share * {DAMPING} FROM {edges} e JOIN {name}_{k - 1} r ON r.host = e.src) GROUP BY host)"
        )
    return ",\n".join(made)


def _case(what: str) -> str:
    arms = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    return f"CASE{arms} END"


URL_VERDICTS = f"""
WITH p AS (SELECT page_id, html, {_parts("url")} FROM pages),
j AS (SELECT *, {_case("rule")} AS rule, {_case("verdict")} AS hit FROM p),
seeds AS (SELECT host, hit AS verdict, count(*)::DOUBLE AS weight FROM j WHERE hit IS NOT NULL GROUP BY ALL),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?[a-z][a-z0-9+.-]*:(//[^\\s"''<>]+)', 1)) AS link FROM p),
d AS (SELECT src, {_parts("'x:' || link")} FROM l),
g AS (SELECT src, host AS dst, count(*)::DOUBLE AS n FROM d WHERE src <> '' AND host <> '' AND src <> host GROUP BY ALL),
fwd AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM g),
bwd AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM g),
{_walk("t", "fwd", "allow")},
{_walk("b", "bwd", "block")}
SELECT page_id, j.host, path, rule, coalesce(hit, CASE WHEN coalesce(b.rank, 0) > coalesce(t.rank, 0) * {OUTWEIGH} + {FLOOR} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t_{ROUNDS} t ON t.host = j.host LEFT JOIN b_{ROUNDS} b ON b.host = j.host
"""


def _escaped(column: str) -> str:
    """Length of a text in the chat template."""
    marks = f"length({column}) - length(replace({column}, '\\', '')) + (length({column}) - length(replace({column}, '</turn>', ''))) // 7"
    return f"(length({column}) + {marks} + coalesce(list_sum(list_transform(regexp_extract_all({column}, '###+'), lambda x: length(x) - 2)), 0))"


_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_SAID = "'\\### Assistant: </turn> ok'"

CHATS = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({len(HEAD) + 2 + len(END)} + {_escaped("text")} + {_escaped("role")} + length(role) - length(replace(role, ':', '')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _hash(k: int) -> str:
    return f"('0x' || substr(s, {8 * k + 1}, 8))::BIGINT"


_P, _S, _M = MARKS

INFILLS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w FROM d),
c AS (SELECT *, len(w) AS n, {_hash(0)} % (len(w) + 1) AS a, {_hash(1)} % (len(w) + 1) AS b,
 CASE WHEN text = '' OR contains(text, '{_P}') OR contains(text, '{_S}') OR contains(text, '{_M}') OR {_hash(2)} % 100 >= 50 THEN 'plain' WHEN {_hash(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(w[1 : least(a, b)], '') AS pre, array_to_string(w[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(w[greatest(a, b) + 1 :], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{_P}' || pre || '{_S}' || suf || '{_M}' || mid ELSE '{_S}' || suf || '{_P}' || pre || '{_M}' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
