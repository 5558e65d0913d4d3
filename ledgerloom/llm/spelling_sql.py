"""SQL that states the spelling variants by another way: words that agree once one letter is left out."""

OP11_SQL = """
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') || ':' || run AS named, run
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents)),
kinds AS (SELECT named, any_value(run) AS run, count(*) AS k, hex(encode(named)) AS x FROM runs GROUP BY named),
crc AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(x), 2),
      lambda i: list_transform(range(8), lambda j: (('0x' || substr(x, i::INT, 2))::BIGINT >> j::INT) & 1)))),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) AS h FROM kinds),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                   ELSE run END AS word FROM crc)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT w.word, w.n, count(other) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m
  FROM words w LEFT JOIN near USING (word) GROUP BY w.word, w.n),
formed AS (SELECT word, n, n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM best),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT c.word, c.root FROM chain c JOIN formed l ON c.root = l.word WHERE l.form IS NULL) r ON f.word = r.word
"""
