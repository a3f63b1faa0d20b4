"""DuckDB oracle SQL fragments shared by the checks in ``registry``.

Each fragment is an independent re-statement of an operator's semantics in
plain SQL over the driver's tables, used only to check the Spark results.
"""
from __future__ import annotations

from quarry.functions.text import PY_SPACE


def sql_str(s: str) -> str:
    """A SQL string literal; control and non-ASCII characters as chr()."""
    out, buf = [], []
    for ch in s:
        if 32 <= ord(ch) < 127 and ch != "'":
            buf.append(ch)
        else:
            if buf:
                out.append("'" + "".join(buf) + "'")
                buf = []
            out.append("chr(39)" if ch == "'" else f"chr({ord(ch)})")
    if buf:
        out.append("'" + "".join(buf) + "'")
    return "(" + " || ".join(out) + ")" if out else "''"


SPACE = sql_str(PY_SPACE)


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACE})"


def char_chunks(src: str, id_expr: str, text_expr: str, tokens: int, overlap: int,
                extra: str = "") -> str:
    """Chunks of ``src`` rows: extra cols, section_id, chunk_id, chunk_index, text."""
    w, s = tokens * 4, (tokens - overlap) * 4
    extra_sel = (extra + ", ") if extra else ""
    return f"""(
      SELECT {extra_sel}section_id,
             printf('%s::chunk_%04d', section_id, i) AS chunk_id,
             CAST(i AS BIGINT) AS chunk_index,
             substring(t, i * {s} + 1, {w}) AS text
      FROM (
        SELECT {extra_sel}{id_expr} AS section_id, {text_expr} AS t,
               unnest(range(0, CASE WHEN length({text_expr}) <= {w} THEN 1
                                    ELSE 1 + (length({text_expr}) - {w} + {s - 1}) // {s} END)) AS i
        FROM {src}
        WHERE length({text_expr}) > 0
      )
    )"""


def hashed_long(src: str, id_col: str, text_col: str, buckets: int = 4096) -> str:
    """Long-form sparse unit vectors: id, bucket, weight."""
    return f"""(
      SELECT {id_col}, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {id_col})) AS weight
      FROM (
        SELECT {id_col}, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {buckets} AS INTEGER) AS bucket,
               count(*) AS tf
        FROM (SELECT {id_col}, unnest(regexp_extract_all(lower(coalesce({text_col}, '')),
                                      '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS tok FROM {src})
        GROUP BY ALL
      )
    )"""


def sparse_top_k(qvec: str, cvec: str, qid: str, cid: str, k: int) -> str:
    """Ranked pairs with their rounded score: qid, cid, score, rk."""
    return f"""(
      SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, {cid}) AS rk
      FROM (
        SELECT q.{qid}, c.{cid}, round(sum(q.weight * c.weight), 6) AS score
        FROM {qvec} q JOIN {cvec} c ON q.bucket = c.bucket
        GROUP BY ALL
      )
      QUALIFY rk <= {k}
    )"""


def section_rows(conv: str = "conversations") -> str:
    """The sections a per-conversation ``Section {turn}. {role}.`` text splits
    back into, stated directly from the turns."""
    return f"""(
      SELECT conv_id AS doc_id,
             CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS section_ord,
             'BNS_' || CAST(turn AS VARCHAR) AS section_id,
             role AS title,
             'Section ' || CAST(turn AS VARCHAR) || '. ' || role || '.' || chr(10) || chr(10)
               || {strip('coalesce(text, ' + chr(39) * 2 + ')')} AS text
      FROM {conv}
    )"""
