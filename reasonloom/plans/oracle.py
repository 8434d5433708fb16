"""DuckDB SQL with the same results as the registered queries.

Written from the rules, not from the Spark code: tokens come from pieces of the
full text with character spans, masks from comparing spans, positions from plain
windows over the whole table.
"""

from __future__ import annotations

from reasonloom.functions.text import NUMBER, WHITESPACE
from reasonloom.plans.reasoning import SYSTEM_PROMPT, reasoning_sql

LENGTH = 1024
PIECES = rf"(?s)</?think>|</?answer>|[{WHITESPACE}]+|[\p{{L}}\p{{N}}]+|."
BOXED = r"(?s)\\boxed\{(.*?)\}"
TAG_LIST = "('<think>', '</think>', '<answer>', '</answer>')"


def _with(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


def reasoning_cte(body_chars: int | None = None) -> str:
    return f"reasoning AS ({reasoning_sql('documents', body_chars)})"


REASONING = reasoning_cte()

TEXTS = f"""texts AS (
  SELECT *, concat(prompt, solution) AS full_text
  FROM (SELECT example_id,
               concat('{SYSTEM_PROMPT}', chr(10), 'Question: ', coalesce(problem, ''), chr(10)) AS prompt,
               coalesce(generated_solution, '') AS solution
        FROM reasoning))"""

BOXES = f"""boxes AS (
  SELECT example_id, has_box,
         CASE WHEN has_box THEN regexp_extract(solution, '{BOXED}', 1) END AS answer,
         CASE WHEN has_box THEN strpos(solution, regexp_extract(solution, '{BOXED}', 0)) + 6 END AS c0,
         CASE WHEN has_box THEN strpos(solution, regexp_extract(solution, '{BOXED}', 0)) + 6
                                + length(regexp_extract(solution, '{BOXED}', 1)) END AS c1
  FROM (SELECT *, regexp_matches(solution, '{BOXED}') AS has_box FROM texts))"""

TOKENS = f"""pieces AS (
  SELECT example_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k
  FROM (SELECT example_id, regexp_extract_all(full_text, '{PIECES}') AS p FROM texts)),
ended AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY example_id ORDER BY k) AS BIGINT) AS e
  FROM pieces),
tokens AS (
  SELECT example_id, row_number() OVER (PARTITION BY example_id ORDER BY k) - 1 AS i,
         piece AS token, e - length(piece) AS s, e
  FROM ended WHERE NOT regexp_full_match(piece, '[{WHITESPACE}]+'))"""


# MATERIALIZED: without it DuckDB 2.0.0 moves a filter of the vocabulary below the
# row_number of `tokens`, which then skips each text's first token (with the
# optimizer's filter_pushdown disabled it does not).
def kept_cte(length: int) -> str:
    return f"""kept AS MATERIALIZED (SELECT * FROM tokens WHERE i < {length}),
starts AS (
  SELECT x.example_id, count(t.i) AS start
  FROM texts x LEFT JOIN tokens t ON t.example_id = x.example_id AND t.s < length(x.prompt)
  GROUP BY x.example_id),
opens AS (
  SELECT b.example_id, min(k.i) AS open_i
  FROM starts b JOIN kept k ON k.example_id = b.example_id AND k.i >= b.start
  WHERE k.token = '<think>' GROUP BY b.example_id),
closes AS (
  SELECT b.example_id, min(k.i) AS any_close,
         min(CASE WHEN k.i > o.open_i THEN k.i END) AS close_i
  FROM starts b JOIN kept k ON k.example_id = b.example_id AND k.i >= b.start
  LEFT JOIN opens o ON o.example_id = b.example_id
  WHERE k.token = '</think>' GROUP BY b.example_id),
marks AS (
  SELECT b.example_id, b.start, length(x.prompt) AS n_prompt, o.open_i, c.close_i,
         CASE WHEN o.open_i IS NOT NULL AND c.close_i IS NULL THEN 'think_unclosed'
              WHEN o.open_i IS NULL AND c.any_close IS NOT NULL THEN 'think_orphan_end'
              ELSE 'ok' END AS think_status,
         bx.has_box, bx.c0, bx.c1
  FROM starts b JOIN texts x USING (example_id) JOIN boxes bx USING (example_id)
  LEFT JOIN opens o USING (example_id) LEFT JOIN closes c USING (example_id)),
masked AS (
  SELECT k.example_id, k.i, k.token, k.i >= m.start AS loss_mask,
         coalesce(k.i > m.open_i AND k.i < m.close_i, false) AS think_mask,
         coalesce(k.i >= m.start AND k.s >= m.n_prompt + m.c0 AND k.e <= m.n_prompt + m.c1,
                  false) AS answer_mask
  FROM kept k JOIN marks m USING (example_id)),
counted AS (
  SELECT m.example_id, count(k.i) AS n_tok, count_if(k.loss_mask) AS n_tgt,
         count_if(k.think_mask) AS n_think, count_if(k.answer_mask) AS n_ans,
         any_value(m.has_box) AS has_box, any_value(m.think_status) AS think_status
  FROM marks m LEFT JOIN masked k USING (example_id) GROUP BY m.example_id),
ex AS (
  SELECT example_id, CAST(n_tok AS BIGINT) AS n_tok, CAST(n_tgt AS BIGINT) AS n_tgt,
         CAST(n_think AS BIGINT) AS n_think, CAST(n_ans AS BIGINT) AS n_ans,
         CASE WHEN NOT has_box THEN 'no_boxed'
              WHEN think_status <> 'ok' THEN think_status
              WHEN n_ans = 0 THEN 'answer_unmapped' ELSE 'ok' END AS status
  FROM counted)"""


KEPT = kept_cte(LENGTH)

RESERVED = """reserved AS (
  SELECT * FROM (VALUES ('<pad>', 0), ('<think>', 1), ('</think>', 2),
                        ('<answer>', 3), ('</answer>', 4)) v(token, id))"""
VOCAB = f"""{RESERVED},
vocab AS MATERIALIZED (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 4 AS id
  FROM (SELECT token, count(*) AS n FROM kept
        WHERE token NOT IN (SELECT token FROM reserved) GROUP BY token)
  UNION ALL SELECT token, CAST(id AS BIGINT) FROM reserved)"""

def scored_ctes(
    batch: str = "k.example_id % 50 AS batch_id", by: str = "batch_id", joined: str = ""
) -> str:
    """`batch` computes the columns that name a batch, `by` lists their names."""
    return f"""usable AS (
  SELECT k.* FROM masked k JOIN ex ON ex.example_id = k.example_id AND ex.status = 'ok'
  WHERE k.i >= 1),
losses AS (
  SELECT token, -ln(count(*) / (SELECT count(*) FROM usable)) AS loss FROM usable GROUP BY token),
scored AS (
  SELECT k.example_id, {batch}, k.i, k.token, l.loss,
         k.loss_mask, k.think_mask, k.answer_mask,
         CASE WHEN NOT k.loss_mask THEN 0.0 WHEN k.token IN {TAG_LIST} THEN 10.0 ELSE 1.0 END AS w
  FROM usable k JOIN losses l ON l.token = k.token {joined}),
base AS (
  SELECT {by}, CASE WHEN count_if(loss_mask) > 0 THEN sum(loss * w) / count_if(loss_mask)
                        ELSE 0.0 END AS base
  FROM scored GROUP BY {by}),
answers AS (
  SELECT example_id, {by}, count(*) AS n_ans, 1 / (1 + exp(-(avg(loss) - 0.5))) AS g
  FROM scored WHERE answer_mask AND loss_mask GROUP BY example_id, {by}),
eff AS (
  SELECT example_id, {by}, CAST(n_ans AS BIGINT) AS n_ans,
         -0.1 * (1 / (n_ans + 1e-6)) * (1 - g) + 0.1 * n_ans * g AS score
  FROM answers),
thoughts AS (
  SELECT example_id, {by}, token,
         row_number() OVER w AS r, lead(token, 1) OVER w AS t1,
         lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3,
         count(*) OVER (PARTITION BY example_id) AS n
  FROM scored WHERE think_mask AND loss_mask
  WINDOW w AS (PARTITION BY example_id ORDER BY i)),
rep AS (
  SELECT example_id, {by}, CAST(count(*) AS BIGINT) AS n_grams,
         (count(*) - count(DISTINCT (token, t1, t2, t3))) / count(*) AS score
  FROM thoughts WHERE n > 4 AND t3 IS NOT NULL GROUP BY example_id, {by})"""

EXAMPLE_PARTS = (REASONING, TEXTS, BOXES, TOKENS, KEPT)
SCORE_PARTS = (*EXAMPLE_PARTS, scored_ctes())

SHUFFLED = """(SELECT example_id, row_number() OVER (
    ORDER BY md5(concat('42:{epoch}:', example_id)), example_id) - 1 AS pos FROM reasoning)"""
BATCHED = f"""batched AS (
  SELECT example_id, pos % 2 AS shard, CAST(floor(floor(pos / 2) / 4) AS BIGINT) AS batch_id
  FROM {SHUFFLED.format(epoch=0)})"""

FILES = "files AS (SELECT source_file, count(*) AS n_rows FROM reasoning GROUP BY source_file)"
RANKED_FILES = f"""{FILES},
ranked AS (SELECT *, row_number() OVER (
    ORDER BY md5(concat('42:', source_file)), source_file) AS r FROM files)"""

RATE = f"""CASE WHEN regexp_matches(pass_rate_72b_tir, '{NUMBER}')
     THEN TRY_CAST(pass_rate_72b_tir AS DOUBLE) END"""


def _words(col: str) -> str:
    return f"len(regexp_extract_all(coalesce({col}, ''), '[^{WHITESPACE}]+'))"


WORDS = f"CAST({_words('problem')} + {_words('generated_solution')} AS BIGINT)"
ANSWERED = "problem_type <> 'no_answer_extracted'"

VOLUME = "SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars_sum FROM documents"


def funnel_sql(max_len: int, body_chars: int | None = None) -> str:
    return _with(
        reasoning_cte(body_chars),
        f"flags AS (SELECT source_file, {ANSWERED} AS a, {RATE} > 0.8 AS r, "
        f"{WORDS} <= {max_len} AS l FROM reasoning)",
        final="SELECT source_file, count(*) AS n0, count(*) FILTER (a) AS n1, "
        "count(*) FILTER (a AND r) AS n2, count(*) FILTER (a AND r AND l) AS n3 FROM flags GROUP BY source_file",
    )


def _mask(name: str) -> str:
    return _with(*EXAMPLE_PARTS, final=f"SELECT example_id, i, {name} AS mask FROM masked")


def _joined(first: int, pad: bool) -> str:
    """Tokens from position `first` on, joined by spaces, padded if asked."""
    fill = (
        f"concat_ws(' ', t, CASE WHEN n < {LENGTH} THEN rtrim(repeat('<pad> ', {LENGTH} - n)) END)"
        if pad
        else "coalesce(t, '')"
    )
    size = str(LENGTH) if pad else "n"
    return _with(
        *EXAMPLE_PARTS,
        f"joined AS (SELECT x.example_id, count(k.i) AS n, "
        f"string_agg(k.token, ' ' ORDER BY k.i) AS t FROM texts x LEFT JOIN kept k "
        f"ON k.example_id = x.example_id AND k.i >= {first} GROUP BY x.example_id)",
        final=f"SELECT example_id, CAST({size} AS BIGINT) AS n, {fill} AS text FROM joined",
    )


def _content(col: str) -> str:
    return f"CAST(sum(CAST('0x' || substr(md5(coalesce({col}, '')), 1, 8) AS BIGINT)) AS BIGINT)"


def _filled(value: str, pad: str) -> str:
    """An example's entries in order, joined by blanks and filled up to the full length."""
    return (
        f"concat(string_agg({value}, ' ' ORDER BY i), repeat(' {pad}', {LENGTH} - CAST(count(*) AS INTEGER)))"
    )


def _sample(limit: str) -> str:
    return _with(
        REASONING,
        RANKED_FILES,
        final=f"SELECT source_file, n_rows FROM ranked WHERE r <= {limit}",
    )


ORACLE: dict[str, str] = {
    "src_parquet_dir": VOLUME,
    "src_parquet_file": VOLUME,
    "src_discover": VOLUME,
    "src_split": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, "
    "count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars_sum FROM documents GROUP BY 1",
    "src_glob": VOLUME,
    "src_jsonl": f"""SELECT CASE WHEN ok THEN 'good' ELSE 'bad' END AS kind, count(*) AS n_rows,
        CASE WHEN ok THEN {_content("text")} ELSE 0 END AS content
        FROM (SELECT *, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS ok FROM documents)
        GROUP BY ok""",
    "src_dispatch": f"""SELECT kind, count(*) AS n_rows, {_content("text")} AS content FROM documents,
        (VALUES ('folder'), ('json lines'), ('parquet file')) v(kind) GROUP BY kind""",
    "path_select": r"""SELECT page_id, url FROM pages
        WHERE regexp_matches(url, '.*\.com/fr.*|.*/es/.*') AND NOT regexp_matches(url, 'ref=.*')""",
    "manifest_files": """SELECT page_id // 20 AS block, array_to_string(string_split(url, '/')[:-2], '/') AS dir,
        string_split(url, '/')[-1] AS name FROM pages WHERE url IS NOT NULL""",
    "write_filtered": _with(
        REASONING,
        final=f"SELECT source_file, count(*) AS n_rows, {_content('generated_solution')} AS content "
        f"FROM reasoning WHERE {ANSWERED} AND {RATE} > 0.8 AND {WORDS} <= 2048 GROUP BY source_file",
    ),
    "sample_files_count": _sample("3"),
    "sample_files_ratio": _sample("(SELECT greatest(1, floor(count(*) * 0.1)) FROM files)"),
    "file_offsets": _with(
        REASONING,
        FILES,
        final="SELECT source_file, n_rows, CAST(coalesce(sum(n_rows) OVER (ORDER BY source_file "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_offset FROM files",
    ),
    "file_offsets_shuffled": _with(
        REASONING,
        RANKED_FILES,
        final="SELECT source_file, n_rows, CAST(coalesce(sum(n_rows) OVER (ORDER BY r "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_offset FROM ranked",
    ),
    "row_at_index": _with(
        REASONING,
        final="SELECT example_id, row_number() OVER (ORDER BY source_file, example_id) - 1 "
        "AS global_idx FROM reasoning",
    ),
    "global_index": "SELECT doc_id, 'documents.parquet' AS source_file, "
    "row_number() OVER (ORDER BY doc_id) - 1 AS global_idx FROM documents",
    "rows_at": "SELECT global_idx, doc_id FROM (SELECT doc_id, count(*) OVER () AS n, "
    "row_number() OVER (ORDER BY doc_id) - 1 AS global_idx FROM documents) "
    "WHERE global_idx IN (0, 7, 500, n - 1)",
    "row_group_lookup": "SELECT global_idx, doc_id, md5(text) AS text_md5 FROM (SELECT doc_id, text, "
    "count(*) OVER () AS n, row_number() OVER (ORDER BY doc_id) - 1 AS global_idx FROM documents) "
    "WHERE global_idx % 50 = 0 OR global_idx = n - 1",
    "sample_copies": _with(
        REASONING,
        RANKED_FILES,
        final=f"SELECT source_file, count(*) AS n_rows, {_content('generated_solution')} AS content "
        "FROM reasoning JOIN (SELECT source_file FROM ranked WHERE r <= 3) USING (source_file) "
        "GROUP BY source_file",
    ),
    "profile": _with(
        REASONING,
        final="\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null "
            "FROM reasoning"
            for c in (
                "example_id",
                "source_file",
                "problem",
                "generated_solution",
                "problem_type",
                "pass_rate_72b_tir",
                "expected_answer",
            )
        ),
    ),
    "filter_answer": _with(REASONING, final=f"SELECT example_id FROM reasoning WHERE {ANSWERED}"),
    "lenient_cast": _with(
        REASONING, final=f"SELECT example_id, {RATE} AS pass_rate FROM reasoning"
    ),
    "filter_pass_rate": _with(
        REASONING,
        final=f"SELECT example_id, {RATE} AS pass_rate FROM reasoning WHERE {RATE} > 0.8",
    ),
    "token_count": _with(REASONING, final=f"SELECT example_id, {WORDS} AS n_tokens FROM reasoning"),
    "filter_length": _with(
        REASONING, final=f"SELECT example_id FROM reasoning WHERE {WORDS} <= 2048"
    ),
    "filter_funnel": funnel_sql(2048),
    "curate": _with(
        REASONING,
        final=f"SELECT * FROM reasoning WHERE {ANSWERED} AND {RATE} > 0.8 AND {WORDS} <= 2048",
    ),
    "curate_mixed_files": _with(
        REASONING,
        "kinds AS (SELECT *, example_id % 4 AS k FROM reasoning)",
        final="SELECT example_id, ['whole', 'unrated', 'unasked', 'numbers'][k + 1] AS kind, "
        "CASE WHEN k <> 2 THEN md5(problem) END AS problem_md5, "
        "md5(generated_solution) AS generated_solution_md5 "
        f"FROM kinds WHERE {ANSWERED} AND (k = 1 OR {RATE} > 0.8) AND (k = 2 OR {WORDS} <= 2048)",
    ),
    "render_prompt": _with(
        REASONING, TEXTS, final="SELECT example_id, prompt, full_text FROM texts"
    ),
    "boxed_answer": _with(
        REASONING, TEXTS, BOXES, final="SELECT example_id, has_box, answer, c0, c1 FROM boxes"
    ),
    "token_spans": _with(
        REASONING, TEXTS, TOKENS, final="SELECT example_id, i, token, s, e FROM tokens"
    ),
    "batch_spans": _with(
        REASONING, TEXTS, TOKENS, final="SELECT example_id, i, s, e FROM tokens"
    ),
    "pad_truncate": _joined(0, pad=True),
    "shifted_labels": _joined(1, pad=False),
    "target_start": _with(*EXAMPLE_PARTS, final="SELECT example_id, start FROM starts"),
    "loss_mask": _mask("loss_mask"),
    "think_mask": _mask("think_mask"),
    "answer_mask": _mask("answer_mask"),
    "think_integrity": _with(
        *EXAMPLE_PARTS, final="SELECT example_id, open_i, close_i, think_status FROM marks"
    ),
    "examples": _with(*EXAMPLE_PARTS, final="SELECT * FROM ex"),
    "example_report": _with(
        *EXAMPLE_PARTS, final="SELECT status, count(*) AS n FROM ex GROUP BY status"
    ),
    "example_arrays": _with(
        *EXAMPLE_PARTS,
        VOCAB,
        f"ids AS (SELECT example_id, {_filled('CAST(id AS VARCHAR)', '0')} AS input_ids "
        "FROM kept JOIN vocab USING (token) GROUP BY example_id)",
        f"masks AS (SELECT example_id, "
        f"{_filled('CAST(CAST(loss_mask AS INTEGER) AS VARCHAR)', '0')} AS loss_mask, "
        f"{_filled('CAST(think_mask AS VARCHAR)', 'false')} AS think_mask, "
        f"{_filled('CAST(answer_mask AS VARCHAR)', 'false')} AS answer_mask "
        "FROM masked GROUP BY example_id)",
        final=f"SELECT example_id, CAST({LENGTH} AS BIGINT) AS n, "
        + ", ".join(
            f"md5({c}) AS {c}_md5" for c in ("input_ids", "loss_mask", "think_mask", "answer_mask")
        )
        + ", n_tok, n_tgt, n_think, n_ans FROM ex JOIN ids USING (example_id) "
        "JOIN masks USING (example_id)",
    ),
    "vocab": _with(*EXAMPLE_PARTS, VOCAB, final="SELECT token, id FROM vocab"),
    "encode_ids": _with(
        *EXAMPLE_PARTS,
        VOCAB,
        final="SELECT example_id, i, id FROM kept JOIN vocab USING (token)",
    ),
    "render_chat": """SELECT conv_id, concat(string_agg(concat('<|im_start|>', role, chr(10), text,
        '<|im_end|>', chr(10)), '' ORDER BY turn), '<|im_start|>assistant', chr(10)) AS prompt
        FROM conversations GROUP BY conv_id""",
    "shuffle_files": _with(
        REASONING, RANKED_FILES, final="SELECT source_file, r - 1 AS file_pos FROM ranked"
    ),
    "shuffle_rows": _with(
        REASONING, final=f"SELECT example_id, pos FROM {SHUFFLED.format(epoch=0)}"
    ),
    "assign_shards": _with(
        REASONING,
        final="SELECT example_id, pos % 4 AS shard, CAST(floor(pos / 4) AS BIGINT) AS slot "
        f"FROM {SHUFFLED.format(epoch=0)}",
    ),
    "assign_shards_padded": _with(
        REASONING,
        f"placed AS (SELECT * FROM {SHUFFLED.format(epoch=1)})",
        "total AS (SELECT count(*) AS n, (7 - count(*) % 7) % 7 AS missing FROM placed)",
        "padded AS (SELECT example_id, pos FROM placed UNION ALL "
        "SELECT example_id, pos + n FROM placed, total WHERE pos < missing)",
        final="SELECT example_id, pos % 7 AS shard, CAST(floor(pos / 7) AS BIGINT) AS slot "
        "FROM padded",
    ),
    "assign_batches": _with(
        REASONING, BATCHED, final="SELECT example_id, shard, batch_id FROM batched"
    ),
    "collate": _with(
        *EXAMPLE_PARTS,
        BATCHED.replace("pos % 2 AS shard", "floor(pos / 2) AS slot, pos % 2 AS shard"),
        f"arrays AS (SELECT example_id, {_filled('token', '<pad>')} AS input_ids, "
        f"{_filled('CAST(CAST(loss_mask AS INTEGER) AS VARCHAR)', '0')} AS loss_mask, "
        f"{_filled('CAST(answer_mask AS VARCHAR)', 'false')} AS answer_mask "
        "FROM masked GROUP BY example_id)",
        final="SELECT shard, batch_id, count(*) AS n_kept, "
        + ", ".join(
            f"md5(string_agg({c}, chr(10) ORDER BY slot)) AS {c}_md5"
            for c in ("input_ids", "loss_mask", "answer_mask")
        )
        + " FROM batched JOIN ex USING (example_id) JOIN arrays USING (example_id) "
        "WHERE status = 'ok' GROUP BY shard, batch_id",
    ),
    "batch_scores": _with(
        *EXAMPLE_PARTS,
        BATCHED,
        scored_ctes(
            "b.shard, b.batch_id", "shard, batch_id", "JOIN batched b ON b.example_id = k.example_id"
        ),
        "e AS (SELECT shard, batch_id, avg(score) AS eff FROM eff GROUP BY shard, batch_id)",
        "r AS (SELECT shard, batch_id, avg(score) AS rep FROM rep GROUP BY shard, batch_id)",
        final="SELECT shard, batch_id, round(base, 6) AS base, round(coalesce(eff, 0), 6) AS eff, "
        "round(coalesce(rep, 0), 6) AS rep, "
        "round(base + 0.1 * coalesce(eff, 0) + 0.05 * coalesce(rep, 0), 6) AS total "
        "FROM base LEFT JOIN e USING (shard, batch_id) LEFT JOIN r USING (shard, batch_id)",
    ),
    "token_ce": """SELECT vec_id, round(top + ln(list_sum(list_transform(embedding, lambda x:
        exp(CAST(x AS DOUBLE) - top)))) - CAST(embedding[label + 1] AS DOUBLE), 6) AS ce
        FROM (SELECT *, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings)""",
    "token_ce_chunked": """SELECT vec_id, round(top + ln(list_sum(list_transform(embedding, lambda x:
        exp(CAST(x AS DOUBLE) - top)))) - CAST(embedding[label + 1] AS DOUBLE), 6) AS ce,
        CAST(len(embedding) AS BIGINT) AS n_ids
        FROM (SELECT *, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings)""",
    "base_loss": _with(*SCORE_PARTS, final="SELECT batch_id, round(base, 6) AS base FROM base"),
    "efficiency": _with(
        *SCORE_PARTS, final="SELECT example_id, n_ans, round(score, 6) AS score FROM eff"
    ),
    "efficiency_batch": _with(
        *SCORE_PARTS,
        final="SELECT b.batch_id, round(coalesce(avg(score), 0), 6) AS eff "
        "FROM base b LEFT JOIN eff USING (batch_id) GROUP BY b.batch_id",
    ),
    "repetition": _with(
        *SCORE_PARTS, final="SELECT example_id, n_grams, round(score, 6) AS score FROM rep"
    ),
    "repetition_batch": _with(
        *SCORE_PARTS,
        final="SELECT b.batch_id, round(coalesce(avg(score), 0), 6) AS rep "
        "FROM base b LEFT JOIN rep USING (batch_id) GROUP BY b.batch_id",
    ),
    "combined": _with(
        *SCORE_PARTS,
        "e AS (SELECT batch_id, avg(score) AS eff FROM eff GROUP BY batch_id)",
        "r AS (SELECT batch_id, avg(score) AS rep FROM rep GROUP BY batch_id)",
        final="SELECT batch_id, round(base, 6) AS base, round(coalesce(eff, 0), 6) AS eff, "
        "round(coalesce(rep, 0), 6) AS rep, "
        "round(base + 0.1 * coalesce(eff, 0) + 0.05 * coalesce(rep, 0), 6) AS total "
        "FROM base LEFT JOIN e USING (batch_id) LEFT JOIN r USING (batch_id)",
    ),
}
