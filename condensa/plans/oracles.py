"""The registered queries in DuckDB SQL, written from their definitions.

They take other ways than the Spark plans on purpose: joins and windows over exploded
tokens where the plans work inside arrays.
"""

from __future__ import annotations

from condensa.operators.sample import MULTIPLIERS, PRIME, ROUNDS, round_keys
from condensa.plans import inputs as P

WORDS = r"""'[\p{L}\p{N}_'']+|[.,!?;"]'"""
PLAIN = r"""'[\p{L}\p{N}_]+|[.,!?;"]'"""
REMOVED = r"""'[^\p{L}\p{N}_.,!?;" ]'"""


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {WORDS})"


def cut_sentences(text: str, upper: str = "A-Z") -> str:
    marked = rf"regexp_replace({text}, '([.?!]) ([{upper}])', '\1' || chr(1) || '\2', 'g')"
    return f"string_split({marked}, chr(1))"


def flat(text: str) -> str:
    return f"replace({text}, chr(10), ' ')"


def with_ctes(*parts: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body


def unfolded(name: str, source: str, array: str, key: str = "doc_id") -> str:
    """CTE: one row per token, `pos` from 1."""
    return (
        f"{name} AS (SELECT {key}, unnest({array}) AS word, "
        f"generate_subscripts({array}, 1) AS pos FROM {source})"
    )


TOKS = f"toks AS (SELECT doc_id, {words('text')} AS w FROM documents)"
DOC_WORDS = unfolded("doc_words", "toks", "w")
VOCAB = f"""vocab AS (
  SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER) AS id
  FROM (SELECT word, count(*) AS n FROM doc_words GROUP BY word)
  QUALIFY id <= {P.VOCAB_WORDS + 3})"""
BASE = (TOKS, DOC_WORDS, VOCAB)
SENTS = f"sents AS (SELECT doc_id, {cut_sentences(flat('text'))} AS s FROM documents)"
PAIRS = """pairs AS (
  SELECT doc_id, array_to_string(s[2:], ' ') AS source, s[1] AS target
  FROM sents WHERE len(s) > 1)"""
TURNS = """pairs AS (
  SELECT conv_id || ':' || turn AS ex_id, text AS source, next_text AS target
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def encoding(
    key: str = "doc_id",
    target: str = "target",
    pairs: str = "pairs",
    prefix: str = "",
    pieces: bool = False,
) -> tuple[str, ...]:
    """CTEs `x_ids`, `y_ids` (key, pos, id), `slots` and `examples` for a pair table.

    With `pieces` the pair table has arrays, and the source is closed by eos as the target is.
    """
    p = prefix
    source, target = ("source", target) if pieces else (words("source"), words(target))
    x = f"""list_concat(coalesce(x, []), list_transform(range({P.TX} - len(coalesce(x, []))),
                          lambda i: 0))"""
    if pieces:
        x = f"""list_concat(list_concat(coalesce(x, [])[1:{P.TX - 1}], [2]),
                          list_transform(range({P.TX - 1} - len(coalesce(x, []))), lambda i: 0))"""
    return (
        f"""{p}cut AS (SELECT {key}, {source}[1:{P.TX}] AS xw,
            {target}[1:{P.TY}] AS yw FROM {pairs})""",
        unfolded(f"{p}xw", f"{p}cut", "xw", key),
        unfolded(f"{p}yw", f"{p}cut", "yw", key),
        f"""{p}xv AS (SELECT t.*, coalesce(v.id, 3) AS vid
            FROM {p}xw t LEFT JOIN vocab v ON t.word = v.word)""",
        f"""{p}yv AS (SELECT t.*, coalesce(v.id, 3) AS vid
            FROM {p}yw t LEFT JOIN vocab v ON t.word = v.word)""",
        f"""{p}slots AS (
            SELECT {key}, word,
                   row_number() OVER (PARTITION BY {key} ORDER BY min(pos)) AS k
            FROM {p}xv WHERE vid = 3 GROUP BY {key}, word QUALIFY k <= {P.MAX_OOV})""",
        *(
            f"""{p}{side}_ids AS (
            SELECT t.{key}, t.pos, t.word, CASE WHEN vid <> 3 THEN vid
                   WHEN s.k IS NOT NULL THEN {P.VOCAB_SIZE} + s.k ELSE 3 END AS id
            FROM {p}{side}v t LEFT JOIN {p}slots s ON t.{key} = s.{key} AND t.word = s.word)"""
            for side in "xy"
        ),
        f"""{p}x_lists AS (SELECT {key}, list(id ORDER BY pos) AS x FROM {p}x_ids GROUP BY {key})""",
        f"""{p}y_lists AS (SELECT {key}, list(id ORDER BY pos) AS y FROM {p}y_ids GROUP BY {key})""",
        f"""{p}dicts AS (
            SELECT {key}, CAST(count(*) AS INTEGER) AS oov_cnt,
                   string_agg(CAST({P.VOCAB_SIZE} + k AS VARCHAR) || '=' || word, ' ' ORDER BY k) AS oov
            FROM {p}slots GROUP BY {key})""",
        f"""{p}examples AS (
            SELECT c.{key},
              {x} AS x,
              list_concat(list_concat(coalesce(y, [])[1:{P.TY - 1}], [2]),
                          list_transform(range({P.TY - 1} - len(coalesce(y, []))), lambda i: 0)) AS y,
              coalesce(oov_cnt, 0) AS oov_cnt, coalesce(oov, '') AS oov
            FROM {p}cut c LEFT JOIN {p}x_lists USING ({key}) LEFT JOIN {p}y_lists USING ({key})
              LEFT JOIN {p}dicts USING ({key}))""",
    )


ENCODED = (*BASE, SENTS, PAIRS, *encoding())
EXAMPLE_COLUMNS = "array_to_string(x, ' ') AS x, array_to_string(y, ' ') AS y, oov_cnt, oov"
LENGTHS = "lengths AS (SELECT len(w) AS value FROM toks)"


def summary(source: str) -> str:
    """CTEs `quart` and `summary` over `source(value)`."""
    return f"""quart AS (
      SELECT min(value) AS min_value, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3,
             max(value) AS max_value FROM {source}),
    summary AS (
      SELECT min_value, q1, q2, q3, max_value,
             CAST(sum(CASE WHEN value < q1 - 1.5 * (q3 - q1)
                        OR value > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers
      FROM {source}, quart GROUP BY ALL)"""


def cutoff_shares(cutoff: int) -> str:
    def share(condition: str) -> str:
        return f"count(*) FILTER ({condition}) / count(*)"

    d = f"(value - {cutoff})"
    inner = [
        f"{share(f'{d} > {a} AND {d} < {b}')} AS share_{a}_{b}"
        for a, b in ((0, 5), (5, 10), (10, 20), (20, 40), (40, 80))
    ]
    return ", ".join([f"{share(f'{d} > 0')} AS share_over", *inner, f"{share(f'{d} > 80')} AS share_over_80"])


HISTOGRAM = """
  SELECT CAST(b.bin AS INTEGER) AS bin, min_value + b.bin * width AS low,
         min_value + b.bin * width + width AS high, coalesce(n, 0) AS n,
         min_value + b.bin * width <= q3 + 2.5 * (q3 - q1) AS shown
  FROM (SELECT *, (max_value - min_value) / 100.0::DOUBLE AS width FROM quart
        WHERE min_value IS NOT NULL) q
  CROSS JOIN (SELECT unnest(range(100)) AS bin) b
  LEFT JOIN (SELECT CASE WHEN width > 0 THEN least(floor((value - min_value) / width), 99)
                    ELSE 0 END AS bin, count(*) AS n
             FROM (SELECT *, (max_value - min_value) / 100.0::DOUBLE AS width FROM {source}, quart)
             GROUP BY 1) f ON b.bin = f.bin"""

SCORES = """
  CASE WHEN rs > 0 THEN round(o / rs, 6) ELSE 0 END AS r,
  CASE WHEN ps > 0 THEN round(o / ps, 6) ELSE 0 END AS p,
  CASE WHEN o > 0 THEN round(2.0::DOUBLE * (o / rs) * (o / ps) / ((o / rs) + (o / ps)), 6)
       ELSE 0 END AS f"""

LEAD = f"""lead AS (SELECT doc_id, {words(cut_sentences('source') + '[1]')} AS pred,
    {words('target')} AS ref FROM pairs)"""


def rouge_n(n: int, distinct: bool = False, pairs: str = "lead") -> tuple[str, ...]:
    """CTEs up to `n{n}` (doc_id, o, ps, rs) over `pairs(doc_id, pred, ref)`."""
    each = "1" if distinct else "count(*)"

    def grams(side: str) -> str:
        gram = f"list_transform(range(1, len({side}) - {n} + 2), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))"
        return f"""{side}{n} AS (SELECT doc_id, g, {each} AS c
          FROM (SELECT doc_id, unnest({gram}) AS g FROM {pairs}) GROUP BY ALL)"""

    return (
        grams("pred"),
        grams("ref"),
        f"""n{n} AS (
          SELECT l.doc_id, coalesce(o, 0)::DOUBLE AS o, coalesce(ps, 0)::DOUBLE AS ps,
                 coalesce(rs, 0)::DOUBLE AS rs
          FROM {pairs} l
          LEFT JOIN (SELECT doc_id, sum(c) AS ps FROM pred{n} GROUP BY 1) USING (doc_id)
          LEFT JOIN (SELECT doc_id, sum(c) AS rs FROM ref{n} GROUP BY 1) USING (doc_id)
          LEFT JOIN (SELECT p.doc_id, sum(least(p.c, r.c)) AS o FROM pred{n} p
                     JOIN ref{n} r ON p.doc_id = r.doc_id AND p.g = r.g GROUP BY 1) USING (doc_id))""",
    )


def lcs(pairs: str = "lead") -> tuple[str, ...]:
    """CTEs up to `nl` (doc_id, o, ps, rs): the textbook table, one row of it per step.

    A cell is the running maximum of `old cell` and `old cell before + match`, and only
    the tokens of `pred` that occur in `ref` change a row.
    """
    return (
        f"""usable AS (SELECT doc_id, pred, ref,
              list_filter(pred, lambda w: list_contains(ref, w)) AS a,
              list_transform(ref, lambda w: 0) AS zero FROM {pairs})""",
        """lcs_rows AS (
          SELECT doc_id, 0 AS i, zero AS cells FROM usable
          UNION ALL
          SELECT doc_id, i + 1,
                 (SELECT list(best ORDER BY j) FROM (
                    SELECT j, max(cand) OVER (ORDER BY j) AS best FROM (
                      SELECT j, greatest(cells[j], CASE WHEN a[i + 1] = ref[j] THEN
                               1 + CASE WHEN j > 1 THEN cells[j - 1] ELSE 0 END ELSE 0 END) AS cand
                      FROM (SELECT unnest(range(1, len(ref) + 1)) AS j))))
          FROM lcs_rows JOIN usable USING (doc_id) WHERE i < len(a))""",
        """nl AS (
          SELECT doc_id, coalesce(cells[len(cells)], 0)::DOUBLE AS o, len(pred)::DOUBLE AS ps,
                 len(ref)::DOUBLE AS rs
          FROM lcs_rows JOIN usable USING (doc_id) WHERE i = len(a))""",
    )


def averages(metric: str, source: str) -> str:
    return f"""SELECT '{metric}' AS metric, round(avg(r), 6) AS r, round(avg(p), 6) AS p,
      round(avg(f), 6) AS f FROM (SELECT
        CASE WHEN rs > 0 THEN o / rs ELSE 0 END AS r, CASE WHEN ps > 0 THEN o / ps ELSE 0 END AS p,
        CASE WHEN o > 0 THEN 2.0::DOUBLE * (o / rs) * (o / ps) / ((o / rs) + (o / ps)) ELSE 0 END AS f
        FROM {source})"""


NAMES = """names AS (SELECT id, word FROM vocab UNION ALL
  VALUES (0, '<pad>'), (1, '<sos>'), (2, '<eos>'), (3, '<unk>'))"""


def decoded(
    side: str, prefix: str = "", ids: str = "", separator: str = " ", name: str = ""
) -> str:
    """CTE `{side}_text`: the text of the ids of one side, pads and eos dropped."""
    ids, name = ids or side, name or side
    shown = f"""SELECT t.doc_id, t.pos,
        CASE WHEN t.id > {P.VOCAB_SIZE} THEN s.word ELSE coalesce(n.word, '<unk>') END AS word
      FROM (SELECT doc_id, unnest({ids}) AS id, generate_subscripts({ids}, 1) AS pos
            FROM {prefix}examples) t
      LEFT JOIN names n ON t.id = n.id
      LEFT JOIN {prefix}slots s ON t.doc_id = s.doc_id AND t.id = {P.VOCAB_SIZE} + s.k
      WHERE t.id NOT IN (0, 2)"""
    return f"""{name}_text AS (SELECT e.doc_id, coalesce(txt, '') AS txt FROM {prefix}examples e
      LEFT JOIN (SELECT doc_id, string_agg(word, '{separator}' ORDER BY pos) AS txt FROM ({shown}) GROUP BY 1)
      USING (doc_id))"""


SENT_WORDS = (
    SENTS,
    """sent_rows AS (SELECT doc_id, unnest(s) AS sentence,
         generate_subscripts(s, 1) - 1 AS step FROM sents)""",
    f"""sent_words AS (SELECT doc_id, step, unnest({words('sentence')}) AS word,
         len({words('sentence')}) AS size FROM sent_rows)""",
)

EXTRACTIVE = (
    *SENT_WORDS,
    "tf AS (SELECT doc_id, word, count(*) AS tf FROM sent_words GROUP BY ALL)",
    "df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL)",
    "total AS (SELECT count(*) AS n FROM documents)",
    """scored AS (
      SELECT r.doc_id, r.step, r.sentence, coalesce(score, 0) AS score
      FROM sent_rows r LEFT JOIN (
        SELECT w.doc_id, w.step, avg(tf.tf * ln(total.n / df.df)) AS score
        FROM sent_words w JOIN tf ON w.doc_id = tf.doc_id AND w.word = tf.word
          JOIN df ON w.word = df.word, total
        GROUP BY ALL) s ON r.doc_id = s.doc_id AND r.step = s.step)""",
    f"""best AS (SELECT * FROM scored QUALIFY row_number() OVER (
        PARTITION BY doc_id ORDER BY round(score, 6) DESC, step) <= {P.SUMMARY_SENTENCES})""",
)

PROBS = (
    *ENCODED,
    """y_real AS (SELECT * FROM (SELECT doc_id, unnest(y) AS id,
         generate_subscripts(y, 1) - 1 AS pos FROM examples) WHERE id <> 0)""",
    """x_real AS (SELECT * FROM (SELECT doc_id, unnest(x) AS id FROM examples) WHERE id <> 0)""",
    f"""corpus AS (SELECT CASE WHEN id > {P.VOCAB_SIZE - 1} THEN 3 ELSE id END AS id,
          count(*) / (SELECT count(*) FROM y_real) AS p FROM y_real GROUP BY 1)""",
    """x_size AS (SELECT doc_id, count(*) AS size FROM x_real GROUP BY 1)""",
    """copy AS (SELECT doc_id, id, count(*) / any_value(size) AS p
         FROM x_real JOIN x_size USING (doc_id) GROUP BY 1, 2)""",
    f"""probs AS (
      SELECT y.doc_id, y.pos, y.id, coalesce(g.p, 0) AS p_corpus, coalesce(c.p, 0) AS p_copy,
             {P.P_GEN}::DOUBLE * coalesce(g.p, 0)
             + (1.0::DOUBLE - {P.P_GEN}::DOUBLE) * coalesce(c.p, 0) AS p_final
      FROM y_real y LEFT JOIN corpus g ON y.id = g.id
        LEFT JOIN copy c ON y.doc_id = c.doc_id AND y.id = c.id)""",
)



def _shares(number: int) -> str:
    """CTE `shares_n`: what each source id takes of a target id, by the table before round n."""
    w = "nx::DOUBLE" if number == 0 else "nx * p"
    source = "id_pairs" if number == 0 else f"id_pairs JOIN table_{number} USING (x, y)"
    return f"""shares_{number} AS MATERIALIZED (
      SELECT *, w / total AS share FROM (
        SELECT *, sum(w) OVER (PARTITION BY doc_id, y) AS total FROM (SELECT *, {w} AS w FROM {source})))"""


def _side(side: str) -> str:
    return f"""{side}_side AS (SELECT doc_id, {side}, count(*) AS n{side} FROM (
        SELECT doc_id, CASE WHEN i >= {P.VOCAB_SIZE} THEN 3 ELSE i END AS {side}
        FROM (SELECT doc_id, unnest({side}) AS i FROM examples) WHERE i NOT IN (0, 2)) GROUP BY 1, 2)"""


ALIGNED = (
    *ENCODED,
    _side("x"),
    _side("y"),
    """id_pairs AS MATERIALIZED (SELECT *, sum(nx) OVER (PARTITION BY doc_id, y) AS size
      FROM x_side JOIN y_side USING (doc_id))""",
    *(
        cte
        for r in range(P.ALIGNMENT_ROUNDS)
        for cte in (
            _shares(r),
            f"""table_{r + 1} AS MATERIALIZED (SELECT x, y, c / sum(c) OVER (PARTITION BY x) AS p FROM (
              SELECT x, y, sum(ny * share) AS c FROM shares_{r} GROUP BY 1, 2))""",
        )
    ),
)

DETOKENIZE = f"""
  kinds AS (
    SELECT doc_id, pos, word,
      CASE WHEN pos = 1 OR word NOT IN ('.', '!', '?', ',', ';', '"', '''') THEN 'word'
           WHEN word IN ('.', '!', '?') THEN 'end'
           WHEN word IN (',', ';') THEN 'inner' ELSE 'quote' END AS kind
    FROM doc_words),
  marked AS (
    SELECT *, kind = 'quote' AND (sum(CASE WHEN kind = 'quote' THEN 1 ELSE 0 END)
                OVER w) % 2 = 1 AS opens,
           sum(CASE WHEN kind = 'word' THEN 1 ELSE 0 END) OVER w AS grp
    FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  gaps AS (
    SELECT doc_id, grp + 1 AS grp, bool_or(kind = 'end') AS ended, bool_or(opens) AS opened
    FROM marked WHERE kind <> 'word' GROUP BY ALL),
  shown AS (
    SELECT m.doc_id, m.pos,
      CASE WHEN m.pos = 1 THEN '' WHEN kind = 'word' THEN
             CASE WHEN coalesce(opened, false) THEN '' ELSE ' ' END
           WHEN opens THEN ' ' ELSE '' END
      || CASE WHEN kind = 'word' AND (m.pos = 1 OR coalesce(ended, false))
              THEN replace(upper(m.word[1]), 'ẞ', 'Ss') || lower(m.word[2:]) ELSE m.word END AS piece
    FROM marked m LEFT JOIN gaps g ON m.doc_id = g.doc_id AND m.grp = g.grp AND m.kind = 'word')"""

IDS = (
    *BASE,
    """id_rows AS (SELECT w.doc_id, w.pos, coalesce(v.id, 3) AS id
         FROM doc_words w LEFT JOIN vocab v ON w.word = v.word)""",
    """steps AS (
      SELECT lag(id, 1, 1) OVER w AS prev, id AS next FROM id_rows
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
      UNION ALL
      SELECT arg_max(id, pos), 2 FROM id_rows GROUP BY doc_id
      UNION ALL
      SELECT 1, 2 FROM toks WHERE len(w) = 0)""",
    """trans AS MATERIALIZED (SELECT prev, next, ln(n / sum(n) OVER (PARTITION BY prev)) AS logp
         FROM (SELECT prev, next, count(*) AS n FROM steps GROUP BY ALL) QUALIFY next <> 3)""",
    """starts AS MATERIALIZED (SELECT doc_id AS ex_id, coalesce(id, 2) AS start
         FROM documents LEFT JOIN (SELECT doc_id, id FROM id_rows WHERE pos = 1) USING (doc_id))""",
)


def beam(length_norm: str) -> str:
    """Unrolled steps; `live`: open hypotheses, `shut`: those closed at that step."""
    ctes = [
        *IDS,
        """live_0 AS (SELECT DISTINCT start, start AS last, CAST([] AS INTEGER[]) AS seq,
             0.0::DOUBLE AS logp FROM starts)""",
    ]
    return _beam_steps(ctes, length_norm, P.PATH_LENGTH)


def _beam_steps(ctes: list[str], length_norm: str, length: int) -> str:
    shut, stuck = [], []
    for t in range(length):
        allowed = "AND t.next <> 2" if t == 0 else ""
        factor = (5 + t) ** 0.7 / 6**0.7
        factor = 1 / factor if length_norm == "divide" else factor
        ctes.append(
            f"""top_{t} AS MATERIALIZED (
              SELECT start, t.next AS last, list_append(seq, t.next) AS seq,
                     l.logp + t.logp AS logp
              FROM live_{t} l JOIN trans t ON l.last = t.prev {allowed}
              QUALIFY row_number() OVER (PARTITION BY start
                ORDER BY round(l.logp + t.logp, 9) DESC, list_append(seq, t.next)) <= {P.BEAM_WIDTH})"""
        )
        ctes.append(f"live_{t + 1} AS MATERIALIZED (SELECT * FROM top_{t} WHERE last <> 2)")
        shut.append(
            f"SELECT start, seq, logp * {factor!r}::DOUBLE AS score, true AS done FROM top_{t} WHERE last = 2"
        )
        stuck.append(
            f"SELECT start, seq, logp AS score, false AS done FROM live_{t} l WHERE NOT EXISTS "
            f"(SELECT 1 FROM trans t WHERE t.prev = l.last {allowed})"
        )
    last = f"SELECT start, seq, logp AS score, false AS done FROM live_{length}"
    ctes.append("found AS (" + "\nUNION ALL ".join([*shut, *stuck, last]) + ")")
    ctes.append(
        """answer AS (SELECT *, count(*) FILTER (done) OVER (PARTITION BY start) AS n_finished
             FROM found QUALIFY row_number() OVER (PARTITION BY start
               ORDER BY done DESC, round(score, 9) DESC, seq) = 1)"""
    )
    return with_ctes(
        *ctes,
        body="""SELECT start, ex_id, array_to_string(seq, ' ') AS seq, round(score, 6) AS score,
                  done, n_finished FROM starts JOIN answer USING (start)""",
    )


def pointer(coverage: float) -> str:
    """Unrolled steps over every token that has any probability; `live`, `shut` as in `beam`."""
    p_gen = f"{P.P_GEN}::DOUBLE"
    # the trailing comma of a CTE list: both name the vocabulary and the words of documents
    shared = [c for c in IDS if c not in ENCODED and not c.startswith("starts")]
    ctes = [
        *ENCODED, *shared, NAMES,
        """copied AS MATERIALIZED (
          SELECT doc_id, id, count(*) / any_value(size) AS p FROM (
            SELECT *, count(*) OVER (PARTITION BY doc_id) AS size
            FROM (SELECT doc_id, unnest(x) AS id FROM examples) WHERE id <> 0)
          GROUP BY doc_id, id HAVING id <> 3)""",
        """live_0 AS (SELECT doc_id, 1 AS last, CAST([] AS INTEGER[]) AS seq,
             CAST([] AS DOUBLE[]) AS used, 0.0::DOUBLE AS logp FROM examples)""",
    ]
    shut, stuck = [], []
    for t in range(P.POINTER_LENGTH):
        allowed = "WHERE id <> 2" if t == 0 else ""
        factor = 1 / ((5 + t) ** 0.7 / 6**0.7)
        before = """coalesce(list_sum(list_transform(list_filter(range(1, len(seq) + 1),
            lambda i: seq[i] = id), lambda i: used[i])), 0)"""
        ctes.append(
            f"""parts_{t} AS (
              SELECT doc_id, seq, id, sum(own) AS own, sum(p) AS p FROM (
                SELECT doc_id, seq, t.next AS id, 0.0::DOUBLE AS own, {p_gen} * exp(t.logp) AS p
                FROM live_{t} l JOIN trans t ON l.last = t.prev
                UNION ALL
                SELECT doc_id, seq, c.id, (1.0::DOUBLE - {p_gen}) * c.p, (1.0::DOUBLE - {p_gen}) * c.p
                FROM live_{t} JOIN copied c USING (doc_id)) {allowed} GROUP BY ALL)"""
        )
        ctes.append(
            f"""top_{t} AS MATERIALIZED (
              SELECT doc_id, CASE WHEN id >= {P.VOCAB_SIZE} THEN 3 ELSE id END AS last,
                     list_append(seq, id) AS seq, list_append(used, own / p) AS used,
                     l.logp + ln(p) - {coverage}::DOUBLE * least(own / p, {before}) AS logp
              FROM parts_{t} JOIN live_{t} l USING (doc_id, seq)
              QUALIFY row_number() OVER (PARTITION BY doc_id
                ORDER BY round(l.logp + ln(p) - {coverage}::DOUBLE * least(own / p, {before}), 9) DESC,
                  list_append(seq, id)) <= {P.BEAM_WIDTH})"""
        )
        ctes.append(f"live_{t + 1} AS MATERIALIZED (SELECT * FROM top_{t} WHERE last <> 2)")
        shut.append(
            f"SELECT doc_id, seq, logp * {factor!r}::DOUBLE AS score, true AS done FROM top_{t} WHERE last = 2"
        )
        stuck.append(
            f"SELECT doc_id, seq, logp AS score, false AS done FROM live_{t} l WHERE NOT EXISTS "
            f"(SELECT 1 FROM parts_{t} p WHERE p.doc_id = l.doc_id AND p.seq = l.seq)"
        )
    last = f"SELECT doc_id, seq, logp AS score, false AS done FROM live_{P.POINTER_LENGTH}"
    ctes.append("found AS (" + "\nUNION ALL ".join([*shut, *stuck, last]) + ")")
    ctes.append(
        """answer AS (SELECT *, count(*) FILTER (done) OVER (PARTITION BY doc_id) AS n_finished
             FROM found QUALIFY row_number() OVER (PARTITION BY doc_id
               ORDER BY done DESC, round(score, 9) DESC, seq) = 1)"""
    )
    ctes.append(
        f"""shown AS (
          SELECT a.doc_id, string_agg(CASE WHEN a.id > {P.VOCAB_SIZE} THEN s.word
              ELSE coalesce(n.word, '<unk>') END, ' ' ORDER BY a.pos) AS text
          FROM (SELECT doc_id, unnest(seq) AS id, generate_subscripts(seq, 1) AS pos FROM answer) a
            LEFT JOIN names n ON a.id = n.id
            LEFT JOIN slots s ON a.doc_id = s.doc_id AND a.id = {P.VOCAB_SIZE} + s.k
          WHERE a.id <> 2 GROUP BY a.doc_id)"""
    )
    return with_ctes(
        *ctes,
        body="""SELECT doc_id, array_to_string(seq, ' ') AS seq, round(score, 6) AS score, done,
                  n_finished, coalesce(text, '') AS text FROM answer LEFT JOIN shown USING (doc_id)""",
    )


SMOOTHED = (
    *IDS[:5],
    "counts AS MATERIALIZED (SELECT prev, next, count(*) AS n FROM steps GROUP BY ALL)",
    f"""left_out AS (SELECT prev, CAST(sum(n) AS BIGINT) AS total,
          {P.DISCOUNT}::DOUBLE * count(*) / sum(n) AS backoff FROM counts GROUP BY prev)""",
    """continued AS (SELECT next, count(*) / (SELECT count(*) FROM counts) AS p_next
          FROM counts GROUP BY next)""",
)


def smoothed_beam() -> str:
    """Steps as in `beam`, over the best of all pairs of tokens, seen or not."""
    ctes = [
        *SMOOTHED,
        f"""trans AS MATERIALIZED (
          SELECT l.prev, c.next, ln(coalesce(n - {P.DISCOUNT}::DOUBLE, 0) / l.total
                   + l.backoff * c.p_next) AS logp
          FROM left_out l CROSS JOIN continued c LEFT JOIN counts n ON n.prev = l.prev AND n.next = c.next
          WHERE c.next <> 3 QUALIFY row_number() OVER (
            PARTITION BY l.prev ORDER BY round(logp, 9) DESC, c.next) <= 20)""",
        IDS[6],
        """live_0 AS (SELECT DISTINCT start, start AS last, CAST([] AS INTEGER[]) AS seq,
             0.0::DOUBLE AS logp FROM starts)""",
    ]
    return _beam_steps(ctes, "divide", P.SMOOTHED_LENGTH)


def epoch_order() -> str:
    """The permutation step by step: numbers beyond the rows walk on in the recursion."""
    keys = round_keys(P.SEED, P.EPOCH)

    def mixed(source: str) -> str:
        nested = f"(SELECT *, value >> half AS l0, value & ((1 << half) - 1) AS r0 FROM {source})"
        for r, (key, multiplier) in enumerate(zip(keys, MULTIPLIERS)):
            drawn = f"(((r{r} + {key}) % {PRIME} * {multiplier} % {PRIME}) & ((1 << half) - 1))"
            nested = f"(SELECT *, r{r} AS l{r + 1}, xor(l{r}, {drawn}) AS r{r + 1} FROM {nested})"
        return f"SELECT doc_id, n, half, (l{ROUNDS} << half) | r{ROUNDS} AS value FROM {nested}"

    return with_ctes(
        """rows AS (SELECT doc_id, n, CAST(greatest(1, ceil(log2(greatest(2, n)) / 2)) AS BIGINT) AS half,
             row_number() OVER (ORDER BY doc_id) - 1 AS value
           FROM documents, (SELECT count(*) AS n FROM documents))""",
        f"walk AS ({mixed('rows')} UNION ALL {mixed('(SELECT * FROM walk WHERE value >= n)')})",
        body=f"""SELECT doc_id, value AS place, value // {P.BATCH_SIZE} AS batch_id,
                   value % {P.BATCH_SIZE} AS row_in_batch FROM walk WHERE value < n""",
        recursive=True,
    )


def greedy() -> str:
    ctes = [
        *IDS,
        """best AS MATERIALIZED (SELECT prev, next, logp FROM trans QUALIFY row_number() OVER (
             PARTITION BY prev ORDER BY round(logp, 9) DESC, next) = 1)""",
        """walk_0 AS (SELECT DISTINCT start, start AS last, CAST([] AS INTEGER[]) AS seq,
             0.0::DOUBLE AS logp, false AS done FROM starts)""",
    ]
    for t in range(P.PATH_LENGTH):
        ctes.append(
            f"""walk_{t + 1} AS MATERIALIZED (
              SELECT start, CASE WHEN next <> 2 THEN next END AS last,
                     CASE WHEN next IS NULL THEN seq ELSE list_append(seq, next) END AS seq,
                     w.logp + coalesce(b.logp, 0) AS logp, done OR coalesce(next = 2, false) AS done
              FROM walk_{t} w LEFT JOIN best b ON w.last = b.prev)"""
        )
    return with_ctes(
        *ctes,
        body=f"""SELECT start, ex_id, array_to_string(seq, ' ') AS seq, round(logp, 6) AS logp, done
                   FROM starts JOIN walk_{P.PATH_LENGTH} USING (start)""",
    )


def sentence_rows(upper: str) -> str:
    return f"""SELECT doc_id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos
      FROM (SELECT doc_id, {cut_sentences(flat('text'), upper)} AS s FROM documents)"""


def cut_as_target(text: str) -> str:
    return f"array_to_string({words(text)}[1:{P.TY - 1}], ' ')"


def judging(predicted: str, source: str, only: str = "") -> tuple[str, ...]:
    """CTEs from decoded examples to scores; `predicted` is the prediction in `source(doc_id)`."""
    return (
        *ENCODED,
        NAMES,
        decoded("x"),
        decoded("y"),
        f"""judged AS (SELECT doc_id, x_text.txt AS text, y_text.txt AS ref_summary,
          coalesce({predicted}, '') AS pred_summary
          FROM x_text JOIN y_text USING (doc_id) LEFT JOIN {source} USING (doc_id) {only})""",
        """lead AS (SELECT doc_id,
         list_filter(string_split(pred_summary, ' '), lambda w: w <> '') AS pred,
         list_filter(string_split(ref_summary, ' '), lambda w: w <> '') AS ref FROM judged)""",
        *rouge_n(1),
        *rouge_n(2),
        *lcs(),
        f"""drawn AS (SELECT * FROM judged
          ORDER BY md5(doc_id || ':{P.SEED}'), doc_id LIMIT {P.SAMPLES})""",
    )


JUDGED = judging(cut_as_target(cut_sentences("source") + "[1]"), "pairs")
REPORT_SCORES = ", ".join(
    f"(SELECT {m} FROM ({averages('', f'n{k}')})) AS rouge_{k}_{m}" for k in "12l" for m in "rpf"
)


SUMMARISED = f"""(SELECT doc_id, string_agg(sentence, ' ' ORDER BY step) AS summary
    FROM best GROUP BY 1)"""
BATCHED = f"""QUALIFY row_number() OVER (ORDER BY doc_id)
    <= ((SELECT count(*) FROM x_text) - 1) // {P.BATCH_SIZE} * {P.BATCH_SIZE}"""
OWN_IDS = f"""(SELECT e.doc_id, o_text.txt AS own FROM examples e JOIN o_text USING (doc_id)
    WHERE left(md5(array_to_string(e.x, ' ')), 1) >= '3')"""


def piece_array(text: str) -> str:
    each = f"""list_transform(regexp_extract_all(w, '(?s).{{1,{P.PIECE_CHARS}}}'),
      lambda p, i: CASE WHEN i = 1 THEN '\u2581' || p ELSE p END)"""
    cut = f"list_filter(string_split(trim(regexp_replace({text}, ' +', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"flatten(list_transform({cut}, lambda w: {each}))"


def cleaned(text: str) -> str:
    return f"regexp_replace(lower({text}), {REMOVED}, '', 'g')"


PIECES = (
    SENTS,
    f"""text_pairs AS (
      SELECT doc_id, array_to_string(s[2:], ' ') AS source, s[1] AS target FROM sents WHERE len(s) > 1)""",
    f"""pairs AS MATERIALIZED (SELECT doc_id, {piece_array(cleaned('source'))} AS source,
          {piece_array(cleaned('target'))} AS target FROM text_pairs)""",
    "toks AS (SELECT doc_id, list_concat(source, target) AS w FROM pairs)",
    DOC_WORDS,
    VOCAB,
    *encoding(pieces=True),
)


def marked(text: str) -> str:
    kept = f"list_filter(string_split(trim(regexp_replace({cleaned(text)}, ' +', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"list_transform({kept}, lambda w: '\u2581' || w)"


# the last five: best totals end by end, then the cut from the end of each word
SCORED = (
    SENTS,
    f"""marked AS MATERIALIZED (SELECT doc_id, {marked("array_to_string(s[2:], ' ')")} AS source,
          {marked('s[1]')} AS target FROM sents WHERE len(s) > 1)""",
    """all_words AS MATERIALIZED (SELECT w, count(*) AS n
          FROM (SELECT unnest(list_concat(source, target)) AS w FROM marked) GROUP BY w)""",
    f"""parts AS MATERIALIZED (SELECT w, n, st - 1 AS st, st - 1 + l AS en, substring(w, st, l) AS word
          FROM (SELECT *, unnest(range(1, {P.PIECE_CHARS} + 1)) AS l
                FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS st FROM all_words))
          WHERE st + l - 1 <= length(w))""",
    f"""vocab AS MATERIALIZED (
          SELECT *, round(ln(n / sum(n) OVER ()), 6) AS score FROM (
            SELECT word, CAST(sum(n) AS BIGINT) AS n,
                   CAST(row_number() OVER (ORDER BY sum(n) DESC, word) + 3 AS INTEGER) AS id
            FROM parts GROUP BY word QUALIFY id <= {P.VOCAB_WORDS + 3}))""",
    """edges AS (SELECT w, st, en, coalesce(v.score, CASE WHEN en - st = 1 THEN
            (SELECT round(min(score) - 10, 6) FROM vocab) END) AS score
          FROM parts LEFT JOIN vocab v USING (word))""",
    """ends AS MATERIALIZED (SELECT w, en, list({'st': st, 'sc': score}) AS options
          FROM edges WHERE score IS NOT NULL GROUP BY w, en)""",
    """best AS (
          SELECT w, 0::BIGINT AS e, [0.0::DOUBLE] AS totals, [0::BIGINT] AS starts FROM all_words
          UNION ALL
          SELECT w, e + 1, list_append(totals, c.v), list_append(starts, c.st) FROM (
            SELECT b.*, list_sort(list_transform(options, lambda o:
              {'r': -round(totals[o.st + 1] + o.sc, 9), 'st': o.st, 'v': totals[o.st + 1] + o.sc}))[1] AS c
            FROM best b JOIN ends o ON o.w = b.w AND o.en = b.e + 1))""",
    """back AS (
          SELECT w, starts, length(w)::BIGINT AS place, CAST([] AS VARCHAR[]) AS pieces
          FROM best WHERE e = length(w)
          UNION ALL
          SELECT w, starts, starts[place + 1], list_prepend(substring(w, starts[place + 1] + 1, place - starts[place + 1]), pieces)
          FROM back WHERE place > 0)""",
    "cuts AS MATERIALIZED (SELECT w, pieces FROM back WHERE place = 0)",
)
SCORED_PAIRS = (
    *(
        f"""{side}_pieces AS (SELECT doc_id, flatten(list(pieces ORDER BY pos)) AS {side}
          FROM (SELECT doc_id, unnest({side}) AS w, generate_subscripts({side}, 1) AS pos FROM marked)
          JOIN cuts USING (w) GROUP BY doc_id)"""
        for side in ("source", "target")
    ),
    """pairs AS MATERIALIZED (SELECT doc_id, coalesce(s.source, []) AS source, coalesce(t.target, []) AS target
          FROM marked m LEFT JOIN source_pieces s USING (doc_id) LEFT JOIN target_pieces t USING (doc_id))""",
    *encoding(pieces=True),
)
MISSING = """holes AS (SELECT ex_id,
    CASE WHEN substring(md5(ex_id), 1, 1) >= '5' THEN source ELSE '' END AS source,
    CASE WHEN substring(md5(ex_id), 2, 1) >= '4' THEN target ELSE '' END AS target FROM pairs)"""
DRAWN = "substring(md5(CAST(doc_id AS VARCHAR)), 1, 1)"
TURN_KEYS = "SELECT conv_id || ':' || turn AS turn_key, role FROM conversations"


def all_oracles() -> dict[str, str]:
    encoded = with_ctes(*ENCODED, body=f"SELECT doc_id, {EXAMPLE_COLUMNS} FROM examples")
    decode = with_ctes(
        *ENCODED,
        NAMES,
        decoded("x"),
        decoded("y"),
        body="""SELECT doc_id, x_text.txt AS source_text, y_text.txt AS target_text
                FROM x_text JOIN y_text USING (doc_id)""",
    )
    vocab = with_ctes(*BASE, body="SELECT word, id, n FROM vocab")
    length = P.CUTOFF
    half = P.MAX_OOV // 2
    lead_pairs = (SENTS, PAIRS, LEAD)
    pred_target = cut_sentences("source") + "[1]"
    return {
        "tokenize_words": f"SELECT doc_id, array_to_string({words('text')}, ' ') AS tokens FROM documents",
        "tokenize_plain": f"""SELECT doc_id,
            array_to_string(regexp_extract_all(text, {PLAIN}), ' ') AS tokens FROM documents""",
        "clean_chars": f"""SELECT doc_id, regexp_replace(lower(text), {REMOVED}, '', 'g') AS cleaned
            FROM documents""",
        "normalize_text": f"""SELECT conv_id, turn, array_to_string({words('text')}, ' ') AS normalized
            FROM conversations""",
        "split_sentences": sentence_rows("A-Z"),
        "split_sentences_unicode": sentence_rows(r"\p{Lu}"),
        "sentence_corpus": f"""SELECT lower(unnest({cut_sentences(flat('text'))})) AS sentence
            FROM documents""",
        "sentence_corpus_head": f"""SELECT lower(unnest({cut_sentences(flat('text'))})) AS sentence
            FROM (SELECT text FROM documents QUALIFY row_number() OVER (ORDER BY doc_id)
                  <= (SELECT ceil(0.5 * count(*)) FROM documents))""",
        "detokenize": with_ctes(
            TOKS,
            DOC_WORDS,
            DETOKENIZE,
            body="""SELECT d.doc_id, coalesce(fixed, '') AS fixed FROM documents d LEFT JOIN
              (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS fixed FROM shown GROUP BY 1) s
              ON d.doc_id = s.doc_id""",
        ),
        "detokenize_raw": with_ctes(
            r"""toks AS (SELECT doc_id,
              regexp_extract_all(text, '[^\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+') AS w FROM documents)""",
            DOC_WORDS,
            DETOKENIZE,
            body="""SELECT d.doc_id, coalesce(fixed, '') AS fixed FROM documents d LEFT JOIN
              (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS fixed FROM shown GROUP BY 1) s
              ON d.doc_id = s.doc_id""",
        ),
        "build_vocab": vocab,
        "vocab_roundtrip": vocab,
        "encode_examples": encoded,
        "encode_examples_joined": encoded,
        "examples_parquet": encoded,
        "encode_turns": with_ctes(
            *BASE, TURNS, *encoding("ex_id"), body=f"SELECT ex_id, {EXAMPLE_COLUMNS} FROM examples"
        ),
        **dict.fromkeys(
            ("encode_missing_sides", "encode_missing_sides_joined"),
            with_ctes(
                *BASE,
                TURNS,
                MISSING,
                *encoding("ex_id", pairs="holes"),
                body=f"SELECT 'same' AS ex_id, {EXAMPLE_COLUMNS} FROM examples",
            ),
        ),
        "subword_encode": with_ctes(
            *PIECES, body=f"SELECT doc_id, {EXAMPLE_COLUMNS} FROM examples"
        ),
        "subword_decode": with_ctes(
            *PIECES,
            NAMES,
            decoded("x", separator=""),
            decoded("y", separator=""),
            body="""SELECT doc_id,
              regexp_replace(replace(x_text.txt, '\u2581', ' '), '^ ', '') AS source_text,
              regexp_replace(replace(y_text.txt, '\u2581', ' '), '^ ', '') AS target_text
              FROM x_text JOIN y_text USING (doc_id)""",
        ),
        "piece_scores": with_ctes(*SCORED[:5], body="SELECT word, id, n, score FROM vocab"),
        "subword_cut": with_ctes(
            *SCORED, body="SELECT w AS word, array_to_string(pieces, ' ') AS pieces FROM cuts", recursive=True
        ),
        "subword_encode_scored": with_ctes(
            *SCORED, *SCORED_PAIRS, body=f"SELECT doc_id, {EXAMPLE_COLUMNS} FROM examples", recursive=True
        ),
        "subword_decode_scored": with_ctes(
            *SCORED, *SCORED_PAIRS, NAMES, decoded("x", separator=""), decoded("y", separator=""),
            body="""SELECT doc_id,
              regexp_replace(replace(x_text.txt, '\u2581', ' '), '^ ', '') AS source_text,
              regexp_replace(replace(y_text.txt, '\u2581', ' '), '^ ', '') AS target_text
              FROM x_text JOIN y_text USING (doc_id)""",
            recursive=True,
        ),
        "merge_pieces": f"""SELECT doc_id, array_to_string(flatten(list_transform(
              list_transform(regexp_extract_all(text, {PLAIN}), lambda t: {piece_array('t')}),
              lambda p: CASE WHEN len(p) >= 3 THEN [array_to_string(p, '')] ELSE p END)), ' ') AS pieces
            FROM documents""",
        "turn_batches": f"""SELECT *, idx // {P.BATCH_SIZE} AS batch_id,
            idx % {P.BATCH_SIZE} AS row_in_batch
            FROM (SELECT *, row_number() OVER (ORDER BY turn_key) - 1 AS idx FROM ({TURN_KEYS}))""",
        "turn_head_fraction": f"""SELECT * FROM ({TURN_KEYS}) QUALIFY row_number() OVER (ORDER BY turn_key)
            <= (SELECT ceil(0.3 * count(*)) FROM conversations)""",
        "evaluate_exchange_file": with_ctes(
            *judging("own", OWN_IDS)[: len(ENCODED) + 3],
            decoded("x", ids=f"x[1:{P.TY - 1}]", name="o"),
            *judging("own", OWN_IDS)[len(ENCODED) + 3 :],
            body=f"""SELECT {REPORT_SCORES}, CAST((SELECT count(*) FROM drawn) AS INTEGER)
              AS saved_summaries""",
            recursive=True,
        ),
        "evaluate_first_batches": with_ctes(
            *ENCODED,
            *EXTRACTIVE[1:],
            *judging(cut_as_target("summary"), SUMMARISED, BATCHED)[len(ENCODED) :],
            body=f"""SELECT {REPORT_SCORES}, CAST((SELECT count(*) FROM drawn) AS INTEGER)
              AS saved_summaries""",
            recursive=True,
        ),
        "oov_dictionary": with_ctes(
            *ENCODED,
            body=f"SELECT doc_id, CAST({P.VOCAB_SIZE} + k AS INTEGER) AS id, word FROM slots",
        ),
        "teacher_forcing": with_ctes(
            *ENCODED,
            body=f"""SELECT doc_id, array_to_string(list_transform(y,
              lambda i: CASE WHEN i > {P.VOCAB_SIZE - 1} THEN 3 ELSE i END), ' ') AS y_in
              FROM examples""",
        ),
        "length_filter": with_ctes(
            SENTS,
            PAIRS,
            body=f"""SELECT * FROM (SELECT doc_id, CAST(len({words('source')}) AS INTEGER) AS x_len,
              CAST(len({words('target')}) AS INTEGER) AS y_len FROM pairs)
              WHERE x_len <= {length} AND y_len <= {P.TY}""",
        ),
        "id_range_check": with_ctes(
            *ENCODED,
            body="""SELECT count(*) AS n_ids, count(*) FILTER (id < 0 OR id > 65535) AS n_out_of_range,
              CAST(max(id) AS INTEGER) AS max_id
              FROM (SELECT unnest(list_concat(x, y)) AS id FROM examples)""",
        ),
        "jsonl_roundtrip": "SELECT doc_id, text, lang FROM documents",
        "normalized_csv": with_ctes(
            SENTS,
            PAIRS,
            body=f"""SELECT array_to_string({words('source')}, ' ') AS source,
              array_to_string({words('target')}, ' ') AS target FROM pairs""",
        ),
        "ragged_csv_roundtrip": with_ctes(*ENCODED, body=f"SELECT {EXAMPLE_COLUMNS} FROM examples"),
        "decode_examples": decode,
        "decode_examples_joined": decode,
        "real_tokens": with_ctes(
            *ENCODED,
            body="""SELECT doc_id, CAST(len(list_filter(x, lambda i: i <> 0)) AS INTEGER) AS x_real,
              CAST(len(list_filter(y, lambda i: i <> 0)) AS INTEGER) AS y_real FROM examples""",
        ),
        "length_summary": with_ctes(TOKS, LENGTHS, summary("lengths"), body="SELECT * FROM summary"),
        "cutoff_report": with_ctes(TOKS, LENGTHS, body=f"SELECT {cutoff_shares(length)} FROM lengths"),
        "length_histogram": with_ctes(
            TOKS, LENGTHS, summary("lengths"), body=HISTOGRAM.format(source="lengths")
        ),
        "excess_histogram": with_ctes(
            TOKS,
            LENGTHS,
            f"excess AS (SELECT value - {length} AS value FROM lengths WHERE value > {length})",
            summary("excess"),
            body=HISTOGRAM.format(source="excess"),
        ),
        "oov_summary": with_ctes(
            *ENCODED,
            "oovs AS (SELECT CAST(oov_cnt AS BIGINT) AS value FROM examples)",
            summary("oovs"),
            f"shares AS (SELECT {cutoff_shares(half)} FROM oovs)",
            body="SELECT * FROM summary, shares",
        ),
        "batches": f"""SELECT doc_id, idx, idx // {P.BATCH_SIZE} AS batch_id,
            idx % {P.BATCH_SIZE} AS row_in_batch
            FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)""",
        "head_fraction": """SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY doc_id)
            <= (SELECT ceil(0.3 * count(*)) FROM documents)""",
        "eval_sample": f"""SELECT doc_id, text FROM documents
            ORDER BY md5(doc_id || ':{P.SEED}'), doc_id LIMIT {P.SAMPLES}""",
        "lead_k": with_ctes(
            SENTS,
            body=f"""SELECT doc_id, array_to_string(s[1:{P.SUMMARY_SENTENCES}], ' ') AS summary
              FROM sents""",
        ),
        "extractive_summary": with_ctes(
            *EXTRACTIVE,
            body="""SELECT doc_id, string_agg(sentence, ' ' ORDER BY step) AS summary
              FROM best GROUP BY 1""",
        ),
        "rouge_1": with_ctes(*lead_pairs, *rouge_n(1), body=f"SELECT doc_id, {SCORES} FROM n1"),
        "rouge_2": with_ctes(*lead_pairs, *rouge_n(2), body=f"SELECT doc_id, {SCORES} FROM n2"),
        "rouge_2_set": with_ctes(
            *lead_pairs, *rouge_n(2, distinct=True), body=f"SELECT doc_id, {SCORES} FROM n2"
        ),
        "rouge_l": with_ctes(
            *lead_pairs, *lcs(), body=f"SELECT doc_id, {SCORES} FROM nl", recursive=True
        ),
        "rouge_l_ids": with_ctes(
            *ENCODED,
            *encoding(target=pred_target, prefix="p_"),
            """id_pairs AS (SELECT doc_id, p.y[1:list_position(p.y, 2) - 1] AS pred,
                 e.y[1:list_position(e.y, 2) - 1] AS ref
                 FROM p_examples p JOIN examples e USING (doc_id))""",
            *lcs("id_pairs"),
            body=f"SELECT doc_id, {SCORES} FROM nl",
            recursive=True,
        ),
        "rouge_average": with_ctes(
            *lead_pairs,
            *rouge_n(1),
            *rouge_n(2),
            *lcs(),
            body="\nUNION ALL ".join(
                averages(m, s) for m, s in (("rouge-1", "n1"), ("rouge-2", "n2"), ("rouge-l", "nl"))
            ),
            recursive=True,
        ),
        "eval_report": with_ctes(
            *JUDGED,
            body=f"""SELECT doc_id, text, ref_summary, pred_summary,
              (SELECT f FROM ({averages('', 'n1')})) AS rouge_1_f,
              (SELECT f FROM ({averages('', 'n2')})) AS rouge_2_f,
              (SELECT f FROM ({averages('', 'nl')})) AS rouge_l_f
              FROM drawn""",
            recursive=True,
        ),
        "report_file": with_ctes(
            *JUDGED,
            body=f"""SELECT {REPORT_SCORES}, {P.VOCAB_SIZE} AS vocab_size,
              CAST((SELECT count(*) FROM drawn) AS INTEGER) AS saved_summaries,
              text AS first_text, ref_summary AS first_ref_summary,
              pred_summary AS first_pred_summary FROM drawn ORDER BY doc_id LIMIT 1""",
            recursive=True,
        ),
        "evaluated_batches": f"""SELECT doc_id, lang FROM documents
            QUALIFY row_number() OVER (ORDER BY doc_id)
            <= ((SELECT count(*) FROM documents) - 1) // {P.BATCH_SIZE} * {P.BATCH_SIZE}""",
        "encode_new_files": encoded,
        "copy_distribution": with_ctes(
            *PROBS, body="SELECT doc_id, CAST(id AS INTEGER) AS id, round(p, 6) AS p FROM copy"
        ),
        "corpus_distribution": with_ctes(
            *PROBS, body="SELECT CAST(id AS INTEGER) AS id, round(p, 9) AS p FROM corpus"
        ),
        "mixed_distribution": with_ctes(
            *PROBS,
            body="""SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(id AS INTEGER) AS id,
              round(p_corpus, 6) AS p_corpus, round(p_copy, 6) AS p_copy,
              round(p_final, 6) AS p_final FROM probs""",
        ),
        "mixture_nll": with_ctes(
            *PROBS,
            body="""SELECT doc_id, round(avg(-ln(greatest(p_final, 1e-7))), 6) AS nll
              FROM probs GROUP BY 1""",
        ),
        "mixture_nll_joined": with_ctes(
            *PROBS,
            body="""SELECT doc_id, round(avg(-ln(greatest(p_final, 1e-7))), 6) AS nll
              FROM probs GROUP BY 1""",
        ),
        "masked_average": with_ctes(
            *PROBS,
            body="""SELECT round(avg(m), 4) AS masked_average
              FROM (SELECT avg(id) AS m FROM y_real GROUP BY doc_id)""",
        ),
        "coverage_repetition": with_ctes(
            *SENT_WORDS,
            """shares AS (SELECT doc_id, step, word, count(*) / size AS share
                 FROM sent_words GROUP BY doc_id, step, word, size)""",
            """seen AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY doc_id, word ORDER BY step
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS coverage FROM shares)""",
            body="""SELECT doc_id, round(coalesce(penalty, 0), 6) AS penalty FROM documents
              LEFT JOIN (SELECT doc_id, sum(least(share, coverage)) AS penalty FROM seen GROUP BY 1)
              USING (doc_id)""",
        ),
        "bigram_transitions": with_ctes(
            TOKS,
            DOC_WORDS,
            """steps AS (
              SELECT lag(word, 1, '<sos>') OVER w AS prev, word AS next FROM doc_words
                WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
              UNION ALL SELECT arg_max(word, pos), '<eos>' FROM doc_words GROUP BY doc_id
              UNION ALL SELECT '<sos>', '<eos>' FROM toks WHERE len(w) = 0)""",
            """counted AS (SELECT prev, next, count(*) AS n FROM steps GROUP BY ALL)""",
            body="""SELECT prev, next, n, round(ln(n / sum(n) OVER (PARTITION BY prev)), 6) AS logp
              FROM counted""",
        ),
        "epoch_batches": epoch_order(),
        "length_sketch": with_ctes(
            TOKS, LENGTHS,
            body="""SELECT count(*) AS n, min(value) AS min_value, max(value) AS max_value,
                      true AS q1_within, true AS q2_within, true AS q3_within FROM lengths""",
        ),
        "articles_of_lines": f"""SELECT doc_id, text FROM documents WHERE {DRAWN} NOT IN ('0', '1', '2')""",
        "broken_lines": f"""SELECT CASE {DRAWN}
              WHEN '0' THEN '{{"doc_id": ' || doc_id || ', "text": "' || md5(text)
              WHEN '1' THEN '{{"text": "' || md5(text) || '"}}'
              ELSE '{{"doc_id": "' || md5(text) || '", "text": "x"}}' END AS value,
              CASE {DRAWN} WHEN '1' THEN 'no key' ELSE 'broken' END AS reason
            FROM documents WHERE {DRAWN} IN ('0', '1', '2')""",
        "beam_search": beam("divide"),
        "beam_search_smoothed": smoothed_beam(),
        "smoothed_transitions": with_ctes(
            *SMOOTHED,
            body=f"""SELECT prev, next, n, round(ln((n - {P.DISCOUNT}::DOUBLE) / total + backoff * p_next), 6) AS logp
                       FROM counts JOIN left_out USING (prev) JOIN continued USING (next)""",
        ),
        "backoff_weights": with_ctes(
            *SMOOTHED,
            body="SELECT prev, total, round(backoff, 6) AS backoff, 1.0::DOUBLE AS sum FROM left_out",
        ),
        "alignment_likelihood": with_ctes(
            *ALIGNED,
            body=" UNION ALL ".join(
                f"""SELECT {r} AS round, round(sum(ny * share * ln(total / size
                      / {'(SELECT count(DISTINCT y) FROM id_pairs)' if r == 0 else '1'})), 2) AS log_likelihood
                    FROM shares_{r}"""
                for r in range(P.ALIGNMENT_ROUNDS)
            ),
        ),
        "alignment_table": with_ctes(
            *ALIGNED, body=f"SELECT x, y, round(p, 6) AS p FROM table_{P.ALIGNMENT_ROUNDS}"
        ),
        "copy_distribution_learned": with_ctes(
            *ALIGNED,
            _shares(P.ALIGNMENT_ROUNDS),
            f"""place_weights AS (
              SELECT doc_id, x, sum(ny * share / nx) / any_value(words) AS w FROM shares_{P.ALIGNMENT_ROUNDS}
              JOIN (SELECT doc_id, sum(ny) AS words FROM y_side GROUP BY 1) USING (doc_id) GROUP BY 1, 2)""",
            f"""places AS (SELECT doc_id, id, CASE WHEN id >= {P.VOCAB_SIZE} THEN 3 ELSE id END AS x,
                count(*) OVER (PARTITION BY doc_id) AS size
              FROM (SELECT doc_id, unnest(x) AS id FROM examples) WHERE id NOT IN (0, 2))""",
            body="""SELECT doc_id, id, round(sum(coalesce(w, 1.0 / size)), 6) AS p
                      FROM places LEFT JOIN place_weights USING (doc_id, x) GROUP BY 1, 2""",
        ),
        "beam_search_multiply": beam("multiply"),
        "pointer_beam_search": pointer(0.0),
        "pointer_beam_search_joined": pointer(0.0),
        "pointer_beam_coverage": pointer(P.COVERAGE),
        "greedy_path": greedy(),
    }
