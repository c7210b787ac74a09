"""DuckDB SQL of the operators that SQL can express over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
TEXT = "coalesce(text, '')"
LOWER = f"translate({TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(size: int, percent: int) -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {size} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {size - 1}], ' ') END AS h
        FROM w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS u(i) WHERE len(w) > 0),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
      l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)),
      r AS (SELECT x AS doc_id, y AS other FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.other = l.x),
      c AS (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id)
      SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
      FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


QUALITY = rf"""WITH w AS (SELECT doc_id, {TEXT} AS text, {WORDS.format(TEXT)} AS w, list_filter(split({TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
      t AS (SELECT doc_id, i, hash_ FROM (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS hash_ FROM w, unnest(range(1, len(w) - 1)) AS u(i))),
      d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash_) AS k FROM t),
      r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY doc_id),
      m AS (SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
      b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * length(regexp_replace(text, '[^!]+', '', 'g')) > 3 * n_words
        OR 10 * length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > 5 * word_chars) AS kept FROM b"""


def substring(size: int) -> str:
    return f"""WITH w AS (SELECT doc_id, {WORDS.format(TEXT)} AS w FROM documents),
      s AS (SELECT doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') AS h FROM w, unnest(range(1, len(w) - {size - 2})) AS u(i)),
      t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM s) WHERE k > 1),
      g AS (SELECT doc_id, list_distinct(list(i + j)) AS gone FROM t, range(0, {size}) u(j) GROUP BY doc_id),
      k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id))
      SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed,
        sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM k"""


def urls(rules: list[tuple[str, str, str]]) -> str:
    book = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return rf"""WITH rules(verdict, h, p) AS (VALUES {book}),
      rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
      parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
      hit AS (SELECT page_id, max_by(struct_pack(v := verdict, r := h || p), length(h || p) * 2 + (verdict = 'block')::INT) AS best FROM parts JOIN rules
        ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
      SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM parts LEFT JOIN hit USING (page_id)"""


def chat(budget: int, history: int) -> str:
    esc = lambda x: f"replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"
    said = "<|im_end|><|im_start|>assistant ok"
    return rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'),
      p AS (SELECT *, length('<|im_start|>' || replace({esc('role')}, chr(10), '\n') || chr(10) || {esc('text')} || '<|im_end|>' || chr(10)) AS len, len(string_split_regex(trim(text, ' '), '\s+')) + 4 AS tokens FROM t),
      o AS (SELECT *, row_number() OVER w AS pos, sum(tokens) OVER w - tokens AS before, sum(len) OVER w - len AS chars_before
        FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
      y AS (SELECT conv_id, list(before ORDER BY pos) AS befores, list(chars_before ORDER BY pos) AS chars, min(pos) FILTER (role = 'system') AS sys_pos,
        coalesce(min_by(tokens, pos) FILTER (role = 'system'), 0) AS sys_tokens, coalesce(min_by(len, pos) FILTER (role = 'system'), 0) AS sys_len FROM o GROUP BY conv_id),
      -- turn by turn: where the open window starts, its tokens, and the characters of what it repeats
      g(conv_id, pos, start, used, extra) AS (SELECT conv_id, 1::BIGINT, 1::BIGINT, tokens::HUGEINT, 0::HUGEINT FROM o WHERE pos = 1
        UNION ALL SELECT conv_id, pos, CASE WHEN fits THEN start ELSE pos END,
          CASE WHEN fits THEN used + tokens ELSE tokens + CASE WHEN sys THEN sys_tokens ELSE 0 END + before - befores[r] END,
          CASE WHEN fits THEN 0 ELSE CASE WHEN sys THEN sys_len ELSE 0 END + chars_before - chars[r] END
        FROM (SELECT *, least(pos, greatest(start, CASE WHEN sys_pos < pos THEN sys_pos + 1 ELSE 1 END,
            len(list_filter(befores, lambda x: x < before - least({history}, {budget} - tokens - CASE WHEN sys THEN sys_tokens ELSE 0 END))) + 1)) AS r
          FROM (SELECT g.conv_id, o.pos, g.start, g.used, o.tokens, o.before, o.chars_before, befores, chars, sys_pos, sys_tokens, sys_len, g.used + o.tokens <= {budget} AS fits,
              coalesce(sys_pos < o.pos, false) AND (sys_tokens + o.tokens <= {budget} OR (o.tokens > {budget} AND sys_tokens <= {budget})) AS sys
            FROM g JOIN o ON o.conv_id = g.conv_id AND o.pos = g.pos + 1 JOIN y ON y.conv_id = g.conv_id))),
      n AS (SELECT conv_id, (sum(len) + any_value(extra))::BIGINT AS formatted_chars FROM o JOIN (SELECT conv_id, sum(extra) AS extra FROM g GROUP BY conv_id) USING (conv_id) GROUP BY conv_id),
      d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned FROM o GROUP BY conv_id)
      SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM d JOIN n USING (conv_id)"""


INTERACTION = rf"""WITH RECURSIVE l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
      w AS (SELECT doc_id, coalesce(lang, '') AS part, {TEXT} AS text, {WORDS.format(TEXT)} AS w, min(doc_id) OVER (PARTITION BY {TEXT}) AS low FROM documents),
      d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS failed
        FROM w LEFT JOIN l USING (doc_id)),
      c AS (SELECT part, failed, good, toxic, count(*) AS n FROM d GROUP BY ALL),
      x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
      o(filter_order) AS (SELECT x FROM x UNION ALL SELECT filter_order || x FROM o, x WHERE NOT contains(filter_order, x)),
      s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[:step - 1] AS earlier FROM o, unnest(range(1, 6)) AS u(step) WHERE length(filter_order) = 5),
      m AS (SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS sole,
        len(list_filter(string_split(failed, ''), lambda y: y <> '' AND contains(earlier, y))) > 0 AS gone FROM s, c)
      SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (sole), 0)::BIGINT AS unique_fails,
        coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost,
        sum(coalesce(sum(n) FILTER (fails AND NOT gone), 0)) OVER (PARTITION BY part, f)::BIGINT AS shapley
      FROM m GROUP BY part, filter_order, step, f"""


def resample(buckets: int, percent: int, least: int, seed: int) -> str:
    # DuckDB has no crc32: a table of 256 entries by its rule, then a fold over the bytes of each different word
    cut = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH book AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS u(i)),
      w AS (SELECT doc_id, {cut.format(LOWER)} AS w FROM documents), b AS (SELECT {cut.format(LOWER)} AS w FROM benchmark),
      f AS (SELECT doc_id, unnest(w) AS word FROM w), g AS (SELECT unnest(w) AS word FROM b),
      spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM g)),
      k AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
        lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM spelt, book),
      s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (word) GROUP BY bucket),
      n AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
      gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {buckets}) / ((s + 1)::DOUBLE * (tt + {buckets}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
      v AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN k USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
      z AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || sha256('{seed}:' || doc_id)[:8])::BIGINT AS h FROM w LEFT JOIN v USING (doc_id)),
      c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM z),
      r AS (SELECT *, CASE WHEN n_features >= {least} THEN row_number() OVER (PARTITION BY n_features >= {least} ORDER BY score DESC, doc_id) END AS place FROM c)
      SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * (SELECT count(place) FROM r) // 100 THEN place END AS rank FROM r"""
