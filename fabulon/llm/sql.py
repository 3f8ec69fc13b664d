"""DuckDB SQL of the training-data queries that SQL can express; the others are tested against brute force, exact round
trips or held-out accuracy in ``tests/llm``."""

from __future__ import annotations

_SPACES = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

ORACLES: dict[str, str] = {
    "p3_found": f"""select chapter_id from chapters, (select max_size from size_limits where limit_name = 'chapter_piece') l
        where text is not null and len(regexp_extract_all(text, '[^{_SPACES}]+')) > l.max_size""",
    "p5_found": r"""with t as (select 'documents' as src, doc_id as rec_id, text from documents
          union all select 'candidates', cand_id, translated_text from candidates),
        w as (select src, rec_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') as ws from t where text is not null),
        g as (select src, rec_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') as gram
              from w, lateral (select unnest(range(1, len(ws) - 6)) as i) where len(ws) >= 8),
        again as (select src, rec_id, i from (select *, row_number() over (partition by src, rec_id, gram order by i) as k from g) where k > 1),
        inside as (select src, rec_id, count(distinct i + j) as n from again, (select unnest(range(8)) as j) group by src, rec_id)
        select src, rec_id from inside join w using (src, rec_id) where n >= 0.3 * len(ws)""",
}
