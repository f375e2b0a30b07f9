"""DuckDB SQL that encodes ``documents`` from the tokenizer's own file, without the library.

It follows the file's steps: normal form, white space and case; pre-tokens by the file's
pattern; bytes as the characters that stand for them; then, for every distinct word, one
merge at a time, the one of lowest rank (of equal ones the leftmost).  Texts that hold
one of the file's special tokens are outside of it.
"""

from __future__ import annotations

from .bpe import default_tokenizer_path

_ENCODED = r"""
WITH RECURSIVE file AS (SELECT content::JSON AS j FROM read_text('{path}')
), listed AS (SELECT unnest(from_json(j -> '$.model.merges', '[["VARCHAR"]]')) AS m, generate_subscripts(from_json(j -> '$.model.merges', '[["VARCHAR"]]'), 1) AS rank FROM file
), merges AS (SELECT m[1] AS a, m[2] AS b, rank FROM listed
), vocab AS (SELECT unnest(map_entries(from_json(j -> '$.model.vocab', '"MAP(VARCHAR, INTEGER)"'))) AS e FROM file
), ids AS (SELECT e.key AS token, e.value AS id FROM vocab
), plain AS (SELECT b, b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 AS shown FROM range(256) t(b)
), alphabet AS (SELECT list(CASE WHEN shown THEN chr(b::INTEGER) ELSE chr((256 + (SELECT count(*) FROM plain q WHERE NOT q.shown AND q.b < p.b))::INTEGER) END ORDER BY b) AS chars FROM plain p
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS raw,
    lower(regexp_replace(nfc_normalize(coalesce(text, '')), '[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS t FROM documents
), cut AS (SELECT r, regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+') AS ws FROM docs
), words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM cut
), spelled AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM words
), first AS (
  SELECT w, list_transform(range(0, length(h) // 2), lambda i: chars[('0x' || substr(h, 2 * i + 1, 2))::INTEGER + 1]) AS c FROM spelled, alphabet
), bpe(w, s) AS (
  SELECT w, list_concat(c[:-2], [c[-1] || '</w>']) FROM first
  UNION ALL
  SELECT w, list_concat(s[:p - 1], [s[p] || s[p + 1]], s[p + 2:]) FROM (
    SELECT w, any_value(s) AS s, arg_min(p, m.rank * 1000000 + p) AS p
    FROM (SELECT w, s, unnest(range(1, len(s))) AS p FROM bpe) q JOIN merges m ON m.a = q.s[q.p] AND m.b = q.s[q.p + 1] GROUP BY w
  )
), done AS (SELECT w, arg_min(s, len(s)) AS s FROM bpe GROUP BY w
)"""

_HEX = "substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2)"

OP1_SQL = _ENCODED.format(path=default_tokenizer_path()) + f""", tokens AS (SELECT w, unnest(s) AS token, generate_subscripts(s, 1) AS k FROM done
), numbered AS (SELECT w, len(list(id)) AS n, string_agg(lpad(printf('%x', id), 8, '0'), ',' ORDER BY k) AS x, string_agg(token, ' ' ORDER BY k) AS shown FROM tokens JOIN ids USING (token) GROUP BY w
), little AS (SELECT w, n, shown, array_to_string(list_transform(string_split(x, ','), lambda x: {_HEX}), '') AS le FROM numbered
), joined AS (SELECT r, sum(n) AS n, string_agg(le, '' ORDER BY place) AS le, string_agg(shown, ' ' ORDER BY place) AS shown FROM words JOIN little USING (w) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, sha256(unhex(coalesce(le, ''))) AS ids_sha256, sha256(coalesce(shown, '')) AS decoded_sha256
FROM docs LEFT JOIN joined USING (r)
"""

OP5_SQL = _ENCODED.format(path=default_tokenizer_path()) + r""", sized AS (SELECT r, sum(len(s)) AS n FROM words JOIN done USING (w) GROUP BY r
), counts AS (
  SELECT source, lang, 'bpe-1' AS tokenizer, coalesce(n, 0) AS n FROM docs LEFT JOIN sized USING (r)
  UNION ALL SELECT source, lang, 'bytes-1', strlen(raw) FROM docs
  UNION ALL SELECT source, lang, 'words-1', len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) FROM docs
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM counts GROUP BY source, lang, tokenizer
"""
