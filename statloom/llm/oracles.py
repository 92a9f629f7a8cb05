"""DuckDB SQL for longer queries of the subpackage."""

from __future__ import annotations

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")) + " || " + _FIELD + ")"

#: The register of CRC-32 before its final inversion is odd where the checksum is even. Levels are lists; a step is a level
#: with several nodes on a row's way up.
MERKLE = f"""WITH RECURSIVE c AS (SELECT *, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda r, x: list_reduce(list_concat([xor(r, x)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384))) & 1 AS odd FROM documents),
d AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf, {_LEAF.format("CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END")} AS tampered FROM c),
p AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
up AS (SELECT source, 0 AS lvl, list(leaf ORDER BY i) AS l FROM p GROUP BY source
    UNION ALL SELECT source, lvl + 1, list_transform(range(0, len(l), 3), lambda j: sha256(array_to_string(l[j + 1:j + 3], ''))) FROM up WHERE len(l) > 1),
sub AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r FROM up WHERE len(l) = 1),
top AS (SELECT 0 AS lvl, list(subroot ORDER BY r) AS l FROM sub
    UNION ALL SELECT lvl + 1, list_transform(range(0, len(l), 3), lambda j: sha256(array_to_string(l[j + 1:j + 3], ''))) FROM top WHERE len(l) > 1),
w AS (SELECT k, 0 AS tier, lvl, l, i // CAST(power(3, lvl) AS BIGINT) AS a FROM p JOIN up ON p.source IS NOT DISTINCT FROM up.source WHERE len(l) > 1
    UNION ALL SELECT k, 1, lvl, l, r // CAST(power(3, lvl) AS BIGINT) FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source CROSS JOIN top WHERE len(l) > 1),
s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY tier, lvl) AS step, array_to_string(l[a - a % 3 + 1:a], '') AS x, array_to_string(l[a + 2:a - a % 3 + 3], '') AS y FROM w),
f AS (SELECT k, CAST(0 AS BIGINT) AS step, tampered AS h FROM p UNION ALL SELECT f.k, s.step, sha256(s.x || f.h || s.y) FROM f JOIN s ON s.k = f.k AND s.step = f.step + 1),
g AS (SELECT k, arg_max(h, step) AS h FROM f GROUP BY k),
q AS (SELECT k, string_agg(x || y, '' ORDER BY step) AS z FROM s GROUP BY k)
SELECT doc_id, leaf, subroot, t.l[1] AS root, sha256(coalesce(z, '')) AS proof_sha256, g.h AS folded_root, g.h = t.l[1] AS verified
FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source JOIN g USING (k) LEFT JOIN q USING (k) CROSS JOIN (SELECT l FROM top WHERE len(l) = 1) t"""

FILL_IN_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


def url_filter(rules: list[tuple[str, str]], order: int = 4, alphabet: int = 96) -> str:
    """The rules and, for what they leave open, both language models level by level."""
    cases = []
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = text.partition("/")
        cases.append((f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN", text, says))
    rule, verdict = (f"CASE {' '.join(f'{c[0]} {chr(39)}{c[i]}{chr(39)}' for c in cases)} END" for i in (1, 2))
    models = {"a": "a0 + a1", "b": "b0 + b1", "c0": "a1", "d0": "b1", "c1": "a0", "d1": "b0"}
    each = lambda text: ", ".join(text.format(m=m, v=v) for m, v in models.items())
    ctes = [
        r"""u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)""",
        f"""r AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS says, regexp_replace(host || substr(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE url END, length(host) + 1), '[^!-~]', chr(127), 'g') AS t FROM u)""",
        "x AS (SELECT says, t, substr(md5(t), 1, 1) NOT IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS odd, row_number() OVER () AS n FROM (SELECT DISTINCT says, t FROM r))",
        f"e AS (SELECT n, says, odd, substr(s, p, {order + 1}) AS w FROM (SELECT *, repeat(chr(1), {order}) || t || chr(2) AS s, unnest(range(1, length(t) + 2)) AS p FROM x))",
        "c AS (SELECT w, " + ", ".join(f"count(*) FILTER (WHERE says = '{s}' AND odd = {h}) AS {k}{int(h)}" for k, s in (("a", "allow"), ("b", "block")) for h in (False, True)) + " FROM e GROUP BY w)",
    ]
    for n in range(1, order + 2):
        ctes.append(f"g{n} AS (SELECT right(w, {n}) AS g, {each('CAST(sum({v}) AS DOUBLE) AS {m}')} FROM c GROUP BY 1)")
        ctes.append(f"s{n} AS (SELECT left(g, {n - 1}) AS x, {each('sum({m}) AS n{m}, count(*) FILTER (WHERE {m} > 0) AS k{m}')} FROM g{n} GROUP BY 1)")
        low = "1.0 / " + str(alphabet) if n == 1 else "l.{m}"
        values = each("CASE WHEN n{m} + k{m} > 0 THEN g.{m} / (n{m} + k{m}) + k{m} / (n{m} + k{m}) * " + low + " ELSE " + low + " END AS {m}")
        lower = "" if n == 1 else f" JOIN p{n - 1} l ON l.g = right(g.g, {n - 1})"
        ctes.append(f"p{n} AS (SELECT g.g, {values} FROM g{n} g JOIN s{n} s ON s.x = left(g.g, {n - 1}){lower})")
    ctes += [
        f"z AS (SELECT n, round(sum(ln(p.a / p.b)) / count(*), 6) AS score, round(sum(ln(p.c0 / p.d0)) / count(*), 6) AS h0, round(sum(ln(p.c1 / p.d1)) / count(*), 6) AS h1 FROM e JOIN p{order + 1} p ON p.g = e.w GROUP BY n)",
        "y AS (SELECT says, t, score, greatest(-2000, least(2000, CAST(floor((CASE WHEN odd THEN h1 ELSE h0 END) * 100) AS INTEGER))) AS bin FROM x JOIN z USING (n))",
        "b AS (SELECT bin, count(*) FILTER (WHERE says = 'allow') AS a, count(*) FILTER (WHERE says = 'block') AS b FROM y WHERE says IS NOT NULL GROUP BY bin)",
        "v AS (SELECT bin, sum(a) OVER () AS ta, sum(b) OVER () AS tb, sum(a) OVER (ORDER BY bin) AS ca, sum(b) OVER (ORDER BY bin) AS cb, lead(bin) OVER (ORDER BY bin) AS nx FROM b)",
        "k AS (SELECT (ta - ca) * tb - (tb - cb) * ta AS j, bin + 1 AS lo, coalesce(nx, bin + 1) AS hi FROM v UNION ALL SELECT 0, min(bin), min(bin) FROM v)",
        "cut AS (SELECT CASE WHEN (SELECT coalesce(max(ta) * max(tb), 0) FROM v) = 0 THEN 0 ELSE (SELECT floor((lo + hi) / 2.0) / 100 FROM k WHERE lo IS NOT NULL ORDER BY j DESC, lo LIMIT 1) END AS c)",
    ]
    return f"""WITH {", ".join(ctes)}
SELECT page_id, host, path, rule, coalesce(r.says, CASE WHEN score >= c THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN y ON y.t = r.t AND y.says IS NOT DISTINCT FROM r.says CROSS JOIN cut"""
