"""Registered queries of this subpackage. Where SQL can say what a query returns it has an
oracle; of the others (scored graphs, template trees, bisection, token ids, learnt models,
components) tests/llm compares the results with brute force."""

from __future__ import annotations

from codeloom.llm.centroids import centroids_query
from codeloom.llm.infilling import infilling_query
from codeloom.llm.jaccard import jaccard_query
from codeloom.llm.language import language_query
from codeloom.llm.mixing import mixing_query
from codeloom.llm.packing import packing_query
from codeloom.llm.private import private_query
from codeloom.llm.repeats import repeats_query
from codeloom.llm.secrets import secrets_query
from codeloom.llm.tokencount import tokens_query
from codeloom.llm.topk import topk_query
from codeloom.llm.urls import urls_query
from codeloom.llm.vectors import vectors_query

QUERIES = {
    "op1_secrets": secrets_query,
    "op2_repeats": repeats_query,
    "op3_mixing": mixing_query,
    "op4_private": private_query,
    "op5_packing": packing_query,
    "op6_language": language_query,
    "op7_vectors": vectors_query,
    "op8_jaccard": jaccard_query,
    "op9_topk": topk_query,
    "op10_urls": urls_query,
    "op11_tokens": tokens_query,
    "op12_infilling": infilling_query,
    "op13_centroids": centroids_query,
}

_INFILLING = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CAST(len(us) AS BIGINT) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM f),
s AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS x FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM s"""


def _centroids() -> str:
    """Rounds as one CTE after the other: numbers of the nearest centroid, then new centroids."""
    parts = [
        """k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS i, v AS c FROM k
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) <= 16)""",
    ]
    for n in range(4):
        parts.append(
            f"""a{n} AS (SELECT r, vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i := i)) AS best
  FROM k, c{n} GROUP BY r, vec_id, v)"""
        )
        if n < 3:
            parts.append(
                f"""s{n} AS (SELECT best.i AS i, p, sum(x) AS s, count(*) AS m FROM (SELECT best, unnest(range(1, 65)) AS p, unnest(v) AS x FROM a{n}) y GROUP BY ALL),
c{n + 1} AS (SELECT c{n}.i, coalesce(w.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT i, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY p) AS c FROM s{n} GROUP BY i) w ON w.i = c{n}.i)"""
            )
    return (
        "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(best.i AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.i) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.i = best.i"""
    )


ORACLES: dict[str, str] = {"op12_infilling": _INFILLING, "op13_centroids": _centroids()}
