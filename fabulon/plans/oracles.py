"""DuckDB SQL with the results of the catalogue's queries.

Written independently of the Spark plans: joins, windows and lists instead of folds over arrays.  Time warping and the
nested or composed texts (results_table, results_nested, arc_dtw, metric_heatmap_all,
candidate_correlation) have no SQL twin; tests compare them with brute force and published values.
"""

from __future__ import annotations

from ..operators.arcs import smoothing_matrix
from ..settings import HEADINGS, METHOD_LANGUAGES, PAIRS

_SPACES = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{_SPACES}]+')"


_ARCS = r"""
arcs as (
  select distinct slug, run_id, method, version, role, scores from (
    select *, case when regexp_full_match(version, '[a-z]{2}_original') then 'original'
                   when regexp_full_match(version, '[a-z]{2}_human') then 'human'
                   when regexp_matches(version, '^[a-z]{2}_llm') then 'llm' end as role
    from score_docs)
  where role is not null and scores is not null),
open_arcs as (select * replace (list_transform(scores, lambda x: case when not isnan(x) then x end) as scores), len(scores) as n from arcs)"""

_GRID = """(case when len({s}) = 100 then {s}[i + 1] else
  {s}[floor(i * (len({s}) - 1) / 99.0)::int + 1] + (i * (len({s}) - 1) / 99.0 - floor(i * (len({s}) - 1) / 99.0))
  * ({s}[least(floor(i * (len({s}) - 1) / 99.0)::int + 1, len({s}) - 1) + 1] - {s}[floor(i * (len({s}) - 1) / 99.0)::int + 1]) end)"""

_ROLES = (
    "roles as (select slug, run_id, method, "
    + ", ".join(
        f"arg_min(scores, version) filter (role = '{r}') as {r}, min(version) filter (role = '{r}') as {r}_version"
        for r in ("original", "human", "llm")
    )
    + " from arcs group by all)"
)
_SIDES = "sides as (" + " union all ".join(
    f"select slug, run_id, method, '{name}' as pair, {a}_version as version_a, {b}_version as version_b, {a} as x, {b} as y "
    f"from roles where {a} is not null and {b} is not null" for name, a, b in PAIRS
) + ")"
_POINTS = f"""
pp as (
  select * from (
    select slug, run_id, method, pair, 'chapter' as normalization, version_a, version_b, i as pos, least(len(x), len(y)) as length, x[i + 1] as a, y[i + 1] as b
    from sides, lateral (select unnest(range(least(len(x), len(y)))) as i)
    union all
    select slug, run_id, method, pair, 'pct_normalized', version_a, version_b, i, 100, {_GRID.format(s='x')}, {_GRID.format(s='y')}
    from sides, lateral (select unnest(range(100)) as i) where len(x) > 0 and len(y) > 0)
  where a is not null and b is not null and not isnan(a) and not isnan(b))"""
_PAIRED = f"with {_ARCS}, {_ROLES}, {_SIDES}, {_POINTS}"
_KEY = "slug, run_id, method, pair, normalization"
_CORR = "case when min({x}) = max({x}) or min({y}) = max({y}) or count(*) < 2 then null else covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end"
_RANKED = f"""ranked as (
  select *, rank() over (partition by {_KEY} order by a) + (count(*) over (partition by {_KEY}, a) - 1) / 2.0 as ra,
            rank() over (partition by {_KEY} order by b) + (count(*) over (partition by {_KEY}, b) - 1) / 2.0 as rb
  from pp)"""


def _p(r: str, n: str) -> str:
    """Two-sided significance by the finite sums of Student's distribution with n - 2 degrees of freedom."""
    c = f"sqrt(greatest(0, 1 - {r} * {r}))"
    odd = (
        f"2 / pi() * (asin(least(1, abs({r}))) + abs({r}) * coalesce(list_sum(list_transform(range(({n} - 3) // 2), "
        f"lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow({c}, 2 * j + 1))), 0))"
    )
    even = (
        f"abs({r}) * coalesce(list_sum(list_transform(range(({n} - 2) // 2), "
        f"lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow({c}, 2 * j))), 0)"
    )
    return f"case when {r} is null or {n} < 2 then null when {n} = 2 then 1.0 else 1 - (case when {n} % 2 = 1 then {odd} else {even} end) end"


def _weights(plots: bool) -> str:
    rows = []
    for w in (3, 5, 7, 9, 11):
        order = min(3, w - 1) if plots else 3
        if w > order and (plots or w >= 5):
            for r, row in enumerate(smoothing_matrix(w, order)):
                rows += [f"({w},{r},{k},{v!r})" for k, v in enumerate(row)]
    return f"weights(w, r, k, v) as (values {', '.join(rows)})"


def _smoothed(source: str, column: str, keys: str, plots: bool = False) -> str:
    least, window = (3, "least(11, case when n % 2 = 1 then n else n - 1 end)") if plots else (5, "least(11, case when n % 2 = 1 then n else n - 1 end)")
    return f"""
sized as (select *, {window} as w from (select {keys}, {column} as s, len({column}) as n from {source})),
spots as (select {keys}, s, n, w, i, greatest(0, least(i - w // 2, n - w)) as start from sized, lateral (select unnest(range(n)) as i)),
smoothed as (
  select {keys}, n, i as pos, case when n < {least} then any_value(s[i + 1])
    when count(s[start + k + 1]) = count(*) then sum(v * s[start + k + 1]) end as y
  from spots left join weights on weights.w = spots.w and weights.r = spots.i - spots.start and spots.n >= {least}
  group by {keys}, n, i)"""


def _extrema(order: str, compare: str) -> str:
    keys = "slug, run_id, method, version"
    return f"""with {_ARCS}, {_weights(False)}, {_smoothed("open_arcs", "scores", keys)},
    near as (select {keys}, pos, round(y, 9) as y, lag(round(y, 9)) over g as l, lead(round(y, 9)) over g as r
             from smoothed window g as (partition by {keys} order by pos)),
    found as (select {keys}, pos, row_number() over (partition by {keys} order by y {order}, pos) as rank_no
              from near where y {compare} l and y {compare} r)
    select {keys}, rank_no, pos from found where rank_no <= 3"""


def _aligned(order: str, compare: str, name: str) -> str:
    one = "slug, run_id, method, pair, normalization, side"
    return f"""{_PAIRED}, {_weights(False)},
    lists as (select {_KEY}, 'a' as side, list(a order by pos) as s from pp group by all
              union all select {_KEY}, 'b', list(b order by pos) from pp group by all),
    {_smoothed("lists", "s", one)},
    near as (select {one}, n, pos, round(y, 9) as y, lag(round(y, 9)) over g as l, lead(round(y, 9)) over g as r
             from smoothed window g as (partition by {one} order by pos)),
    found as (select * from (select *, row_number() over (partition by {one} order by y {order}, pos) as k
              from near where y {compare} l and y {compare} r) where k <= 3),
    gaps as (select x.slug, x.run_id, x.method, x.pair, x.normalization, x.pos, min(abs(x.pos - y.pos)) / any_value(x.n)::double as d
             from found x join found y on (x.slug, x.run_id, x.method, x.pair, x.normalization) = (y.slug, y.run_id, y.method, y.pair, y.normalization)
             where x.side = 'a' and y.side = 'b' group by all)
    select k.*, round(avg(d), 6) + 0.0 as {name} from (select distinct {_KEY} from pp) k left join gaps using ({_KEY}) group by all"""


_LEXICON = """
lex as (
  select word, arg_max(happs, ord) as happs from (
    select term_id as ord, lower(trim(w)) as word, 1.0::double + 8.0::double * (('0x' || substr(md5(lower(w)), 1, 6))::bigint % 1000) / 999.0::double as happs
    from (select term_id, en as w from glossary union all select term_id, fr from glossary)
    where regexp_full_match(w, '[A-Za-zÀ-ÿ]+'))
  group by word),
telling as (select * from lex where abs(happs - 5.0) > 1.0)"""
_TOKENS = "regexp_extract_all(lower({}), '[a-zà-ÿ]+')"


def _lexicon_score(source: str, keys: str, text: str, name: str = "scored") -> str:
    return f"""
{name} as (
  select {keys}, coalesce((sum(happs * n) / nullif(sum(case when happs is not null then n end), 0) - 5.0) / 4.0, 0.0) as score from (
    select {keys}, word, count(*) as n from (
      select {keys}, unnest(case when len({_TOKENS.format(text)}) > 0 then {_TOKENS.format(text)} else [null] end) as word from {source}) group by all)
  left join telling using (word) group by {keys})"""


def _prefix(source: str, keys: str) -> str:
    """Running sums of lexicon values per white-space word of column ws."""
    return f"""
long as (select {keys}, len(ws) as total, unnest(ws) as w, generate_subscripts(ws, 1) as i from {source}),
per_word as (
  select {keys}, i, sum(happs) as h, count(happs) as c from (
    select {keys}, i, unnest(case when len({_TOKENS.format("w")}) > 0 then {_TOKENS.format("w")} else [null] end) as word from long)
  left join telling using (word) group by all),
cum as (
  select {keys}, 0 as i, 0.0 as h, 0 as c from {source}
  union all
  select {keys}, i, sum(coalesce(h, 0)) over g, sum(c) over g from per_word window g as (partition by {keys} order by i))"""


_FULL = """
full_texts as (
  select run_id, version, string_agg(text, E'\\n\\n' order by number, chapter_id) as t from chapters where text is not null group by all)"""

_RAW = """
raw as (
  select run_id, version, lang, E'Notes\\n*** START OF THE TEXT ***\\n'
    || string_agg(case when heading <> '' then heading || E'\\n\\n' || text else text end, E'\\n\\n\\n' order by number, chapter_id)
    || E'\\n\\n*** END OF THE TEXT ***\\nMore notes' as t,
    count(distinct number) as expected, list(distinct heading) filter (heading <> '') as titles
  from chapters where text is not null and run_id is not null and version is not null group by run_id, version, lang)"""
_BODY = f"""{_RAW}, bodies as (select * replace (
  regexp_replace(regexp_extract(t, '(?s)\\*\\*\\*\\s*START OF[^\\n]*\\n(.*?)\\n\\*\\*\\* END OF', 1), '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g') as t) from raw)"""

_TOP = f"""{_PAIRED},
counted as (select *, length as n, pos as idx from pp where normalization = 'chapter'),
best as (select *, row_number() over (partition by {_KEY} order by round(-abs(a - b), 12), idx) as rank_no from counted)"""


def _passages(method: str, body: str) -> str:
    return f"""{_TOP}, {_FULL}, w as (select run_id, version, t, {_words("t")} as ws from full_texts)
    select slug, best.run_id, method, pair, rank_no,
      coalesce({body.format(w="wa")}, '') as excerpt_a, coalesce({body.format(w="wb")}, '') as excerpt_b
    from best left join w wa on wa.run_id = best.run_id and wa.version = version_a
    left join w wb on wb.run_id = best.run_id and wb.version = version_b
    where rank_no <= 3 and method {method}"""


_CANDIDATES = """
sound as (select * from candidates where correlation is not null and not isnan(correlation)),
chosen as (select run_id, number, cand_idx, correlation from (
  select *, row_number() over (partition by run_id, number order by correlation desc, cand_idx) as k from sound) where k = 1),
tallied as (select run_id, number, count(*) as n_candidates, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens
            from candidates group by all),
picked as (select run_id, number, n_candidates, cand_idx as selected_index, correlation as selected_correlation, input_tokens, output_tokens
           from tallied join chosen using (run_id, number))"""

_ORIGINALS = "originals as (select run_id, number, arg_min(text, chapter_id) as text from chapters where version like '%\\_original' escape '\\' group by all)"
_DONE = "done as (select distinct run_id, number from chapters where version like '%\\_llm%' escape '\\' and text is not null)"


def _segmentation(expected: bool) -> str:
    """Headings by splitting the text at each pattern; the lines of a text for the titles."""
    tries = []
    for lang, rows in HEADINGS.items():
        for k, (label, body) in enumerate(rows):
            lead = r"(?m)^\s{0,4}" if label.startswith("Roman") else r"(?m)^\s*"
            tries.append(f"select '{lang}' as lang, {k} as priority, '{label}' as label, '{lead}(?:{body})\\s*$' as pattern")
    fits = "abs(len(ats) - expected) <= 3 or abs(len(ats) - expected) <= 0.2 * expected" if expected else "true"
    named = """
      marked as (select run_id, version, lang, title, t, '(?m)^\\s*' || regexp_escape(title) || '\\s*$' as pattern from bodies, unnest(titles) u(title)),
      named as (select run_id, version, lang, length(t) - length(regexp_split_to_array(t, pattern)[-1]) - length(regexp_extract_all(t, pattern)[-1]) as off
        from marked where regexp_matches(t, pattern)),
      titled as (select run_id, version, lang, list(off order by off) as ats from named group by run_id, version, lang having count(*) >= 2)"""
    chosen = "select * from fitting" + (
        " union all select run_id, version, lang, 'EXPLICIT_TITLES', ats from titled anti join fitting using (run_id, version, lang)" if expected else ""
    )
    first = f"^[{_SPACES}]*[^{_SPACES}][^\\n]*"
    strip = lambda x: f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"
    return f"""with {_BODY},
      patterns as ({" union all ".join(tries)}),
      matched as (select run_id, version, b.lang, label, priority, expected, t,
          list_transform(regexp_split_to_array(t, pattern), lambda x: length(x)) as gaps, list_transform(regexp_extract_all(t, pattern), lambda x: length(x)) as found
        from bodies b join patterns p on p.lang = case when b.lang = 'fr' then 'fr' else 'en' end),
      placed as (select *, list_transform(range(len(found)), lambda k: list_sum(gaps[1:k + 1]) + coalesce(list_sum(found[1:k]), 0)) as all_at from matched),
      kept as (select *, list_filter(all_at, lambda x, i: coalesce(all_at[i + 1], length(t)) - x > 500) as ats from placed),
      fitting as (select run_id, version, lang, arg_min(label, priority) as label, arg_min(ats, priority) as ats from kept
        where len(ats) >= 2 and ({fits}) group by run_id, version, lang){"," + named if expected else ""},
      chosen as ({chosen}),
      parts as (select run_id, version, lang, label, k as number, ats[k]::bigint as "offset", substr(t, ats[k]::bigint + 1, (coalesce(ats[k + 1], length(t)) - ats[k])::bigint) as chunk
        from chosen join bodies using (run_id, version, lang), lateral (select unnest(range(1, len(ats) + 1)) as k)),
      halves as (select *, regexp_extract(chunk, '^[^\\n]*') as head, regexp_replace(chunk, '^[^\\n]*\\n?', '') as rest from parts),
      lines as (select *, {strip(f"regexp_extract(rest, '{first}')")} as line from halves),
      texts as (select *, case when line <> '' and length(line) < 100 then line else '' end as title,
        {strip(f"case when line <> '' and length(line) < 100 then regexp_replace(rest, '{first}', '') else rest end")} as body from lines)
      select run_id, version, lang as lang_of_text, label as pattern_used, {strip("head")} as heading, title, md5(body) as digest, number, "offset",
        length(body) as char_count, len({_words("body")}) as word_count from texts"""


def _metric(expr: str, name: str, source: str = "pp", extra: str = "") -> str:
    return f"{_PAIRED}{extra} select {_KEY}, round({expr}, 6) + 0.0 as {name} from {source} group by {_KEY}"


def oracle_sql() -> dict[str, str]:
    gate = ", ".join(f"('{m}', '{lang}')" for m, langs in METHOD_LANGUAGES.items() for lang in langs)
    keys = "slug, run_id, method, version"
    pearson, spearman = _CORR.format(x="a", y="b"), _CORR.format(x="ra", y="rb")
    half = "round_even({} * ((total - {w}) / {n}), 0)"
    return {
        "version_triples": """select slug, role, case when (role = 'original') = (direction = 'en_to_fr') then 'en' else 'fr' end as lang,
            case when (role = 'original') = (direction = 'en_to_fr') then 'en' else 'fr' end || '_' || role as version
            from books, (values ('original'), ('human'), ('llm')) r(role)""",
        "wanted_texts": """select slug, unnest(fr_ids)::bigint as gutenberg_id, 'fr' as lang from books
            union all select slug, en_id::bigint, 'en' from books where en_id is not null""",
        "missing_texts": """select * from (select slug, unnest(fr_ids)::bigint as gutenberg_id, 'fr' as lang from books
            union all select slug, en_id::bigint, 'en' from books where en_id is not null)
            where gutenberg_id not in (select gutenberg_id from chapters where gutenberg_id is not null)""",
        "work_filter": """select slug, title, author from books where lower(title) in ('the borrowed boat', 'the_empty_book', 'unknown')
            or lower(slug) in ('the borrowed boat', 'the_empty_book', 'unknown')""",
        "language_gate": f"select method, c.lang, count(*) as n from chapters c join (values {gate}) g(method, lang) on c.lang = g.lang group by all",
        "method_discovery": "select distinct method from score_docs where method is not null",
        "full_texts": f"with {_FULL} select run_id, version, length(t) as chars, md5(t) as digest from full_texts",
        "tokenize_words": f"select chapter_id, length(text) as chars, len({_words('text')}) as words from chapters where text is not null",
        "lexicon_tokens": f"select doc_id, len({_TOKENS.format('text')}) as n, len(list_distinct({_TOKENS.format('text')})) as n_distinct from documents where text is not null",
        "lexicon_table": f"with {_LEXICON} select word, round(happs, 6) + 0.0 as happs from lex",
        "labmt_score": f"with {_LEXICON}, {_lexicon_score('chapters', 'chapter_id', 'text')} select chapter_id, round(score, 6) + 0.0 as score from scored",
        "chunk_weighted_score": f"""with {_LEXICON}, w as (select chapter_id, {_words("coalesce(text, '')")} as ws from chapters),
            parts as (select chapter_id, c as chunk_no, list_slice(ws, c * 350 + 1, c * 350 + 400) as part
                      from w, lateral (select unnest(range(case when len(ws) <= 400 then 1 else 1 + ceil((len(ws) - 400) / 350.0)::int end)) as c)),
            texts as (select chapter_id, chunk_no, len(part) as n_words, array_to_string(part, ' ') as text from parts),
            {_lexicon_score('texts', 'chapter_id, chunk_no, n_words', 'text')}
            select chapter_id, round(coalesce(sum(score * n_words) / nullif(sum(n_words), 0), 0.0), 6) + 0.0 as score from scored group by chapter_id""",
        "sliding_window_arc": f"""with {_LEXICON}, {_FULL}, w as materialized (select row_number() over () as id, run_id, version, {_words('t')} as ws from full_texts),
            {_prefix('w', 'id')},
            runs as materialized (select id, list(h order by i) as h, list(c order by i) as c from cum group by id),
            grid as (select id, run_id, version, len(ws) as total, p as pos, case when len(ws) <= 200 then 0
                else {half.format('p', w='200', n='100.0').replace('total', 'len(ws)')}::int end as s,
                case when len(ws) <= 200 then len(ws) else 200 end as size from w, lateral (select unnest(range(100)) as p))
            select run_id, version, total as total_words, pos,
              round(coalesce(((h[s + size + 1] - h[s + 1]) / nullif(c[s + size + 1] - c[s + 1], 0) - 5.0) / 4.0, 0.0), 6) + 0.0 as score
            from grid join runs using (id)""",
        "mini_arc": f"""with {_LEXICON}, w as (select cand_id, {_words("coalesce(translated_text, '')")} as ws from candidates),
            {_prefix('w', 'cand_id')},
            plan as (select cand_id, len(ws) as n, greatest(50, len(ws) // 5) as size from w),
            counted as (select *, case when n < 50 then 1 else least(10, greatest(1, n - size + 1)) end as k from plan),
            grid as (select cand_id, p as pos, case when k <= 1 then 0 else floor(p * (n - size) / (k - 1)::double)::int end as s,
                     case when k <= 1 then n else size end as size from counted, lateral (select unnest(range(k)) as p))
            select g.cand_id, pos, round(coalesce(((e.h - s.h) / nullif(e.c - s.c, 0) - 5.0) / 4.0, 0.0), 6) + 0.0 as score
            from grid g join cum s on s.cand_id = g.cand_id and s.i = g.s join cum e on e.cand_id = g.cand_id and e.i = g.s + g.size""",
        "arc_build": f"with {_ARCS} select slug, run_id, method, role, version, generate_subscripts(scores, 1) - 1 as pos, round(unnest(scores), 6) + 0.0 as score from arcs",
        "arc_resample": f"with {_ARCS} select {keys}, i as pos, round({_GRID.format(s='scores')}, 6) + 0.0 as score from open_arcs, lateral (select unnest(range(100)) as i) where n > 0",
        "arc_smooth": f"with {_ARCS}, {_weights(False)}, {_smoothed('open_arcs', 'scores', keys)} select {keys}, pos, round(y, 6) + 0.0 as score from smoothed",
        "arc_smooth_plots": f"with {_ARCS}, {_weights(True)}, {_smoothed('open_arcs', 'scores', keys, True)} select {keys}, pos, round(y, 6) + 0.0 as score from smoothed",
        "arc_peaks": _extrema("desc", ">"),
        "arc_troughs": _extrema("asc", "<"),
        "arc_pairs": f"{_PAIRED} select {_KEY}, version_a, version_b, count(*) as n from pp group by all",
        "arc_completeness": f"""with {_ARCS}, {_ROLES} select slug, run_id, method, len(original) as n_original, len(human) as n_human, len(llm) as n_llm
            from roles where original is not null and human is not null and llm is not null""",
        "arc_pearson": _metric(pearson, "pearson_r"),
        "arc_spearman": _metric(spearman, "spearman_rho", "ranked", f", {_RANKED}"),
        "arc_pvalue": f"""{_PAIRED}, {_RANKED}, r as (select {_KEY}, count(*) as n, {pearson} as p, {spearman} as s from ranked group by {_KEY})
            select {_KEY}, round({_p('p', 'n')}, 6) + 0.0 as pearson_p, round(case when n > 2 then {_p('s', 'n')} end, 6) + 0.0 as spearman_p from r""",
        "arc_errors": f"{_PAIRED} select {_KEY}, round(sqrt(avg((a - b) * (a - b))), 6) + 0.0 as rmse, round(avg(abs(a - b)), 6) + 0.0 as mean_abs_diff from pp group by {_KEY}",
        "arc_cosine": _metric("case when sum(a * a) = 0 or sum(b * b) = 0 then 0.0 else sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) end", "cosine_similarity"),
        "peak_alignment": _aligned("desc", ">", "peak_alignment"),
        "trough_alignment": _aligned("asc", "<", "trough_alignment"),
        "top_divergence": f"""{_TOP} select slug, run_id, method, pair, rank_no, idx as window_index, round_even(idx / n::double * 100.0, 1) as narrative_pct,
            round(round_even(a, 4), 6) + 0.0 as score_a, round(round_even(b, 4), 6) + 0.0 as score_b from best where rank_no <= 3""",
        "divergence_passages": _passages("not like 'sw!_%' escape '!'", "substr(array_to_string(list_slice({w}.ws, floor(len({w}.ws) * idx / n::double)::int + 1, floor(len({w}.ws) * idx / n::double)::int + 200), ' '), 1, 500)"),
        "window_passages": _passages(
            "like 'sw!_%' escape '!'",
            "case when len({w}.ws) <= 200 then substr({w}.t, 1, 500) else substr(array_to_string(list_slice({w}.ws, round_even(idx * ((len({w}.ws) - 200) / n::double), 0)::int + 1, round_even(idx * ((len({w}.ws) - 200) / n::double), 0)::int + 200), ' '), 1, 500) end",
        ),
        "qualitative_report": """with x as (select d.*, coalesce(b.title, d.slug) || ' (' || method || ')' as heading,
              case pair when 'original_vs_human' then 1 when 'original_vs_llm' then 2 else 3 end as o,
              case pair when 'original_vs_human' then 'Original vs. Human Translation' when 'original_vs_llm' then 'Original vs. LLM Translation'
                when 'human_vs_llm' then 'Human Translation vs. LLM Translation' else pair end as pair_title from divergences d left join books b using (slug)),
            f as (select *, """ + ", ".join(
                rf"coalesce(regexp_replace(printf('%.10f', {c}), '(\.\d+?)0+$', '\1'), 'nan') as {c}_text" for c in ("narrative_pct", "score_a", "score_b", "abs_diff")
            ) + r""" from x),
            s as (select slug, run_id, method, heading, o, rank_no, case when rank_no = 1 then E'
## ' || pair_title || E'

' else '' end
              || '### Divergence Point ' || rank_no || ' (Window ' || window_index || ', ' || narrative_pct_text || E'% of narrative)

- **' || version_a || '** score: '
              || score_a_text || E'
- **' || version_b || '** score: ' || score_b_text || E'
- Absolute difference: ' || abs_diff_text || E'

**' || version_a || E':**

> '
              || coalesce(excerpt_a, '') || E'

**' || version_b || E':**

> ' || coalesce(excerpt_b, '') || E'
' as s from f)
            select slug, run_id, method, '# Qualitative Analysis: ' || coalesce(min(heading), '') || E'
' || string_agg(s, E'
' order by o, rank_no, s) as report
            from s group by slug, run_id, method""",
        "strategy_comparison": f"""with {_ARCS}, {_weights(True)}, {_smoothed('open_arcs', 'scores', keys + ', role', True)},
            curves as (select {keys}, role, list(y order by pos) as c from smoothed group by all),
            matched as (select l.slug, l.run_id, l.method, l.version, l.c as x, o.c as y from curves l join curves o using (slug, run_id, method)
              where l.role = 'llm' and o.role = 'original'),
            gaps as (select slug, run_id, method, version, i, case when len(x) > 0 and len(y) > 0 then abs({_GRID.format(s='x')} - {_GRID.format(s='y')}) end as gap
              from matched, lateral (select unnest(range(100)) as i))
            select slug, run_id, method, version, round(avg(gap), 6) + 0.0 as mean_gap from gaps group by all""",
        "best_of_n": f"""with {_CANDIDATES} select run_id, number, n_candidates, selected_index::bigint as selected_index,
            round(selected_correlation, 6) + 0.0 as selected_correlation, input_tokens, output_tokens from picked""",
        "temperature_sweep": f"""with {_LEXICON}, {_ORIGINALS}, {_lexicon_score('originals', 'run_id, number', 'text', 'base')},
            cands as (select * from candidates where translated_text is not null),
            {_lexicon_score('cands', 'run_id, number, cand_idx, temperature', 'translated_text')},
            j as (select run_id, number, cand_idx, temperature, scored.score, base.score as original_score, abs(scored.score - base.score) as delta
                  from scored join base using (run_id, number)),
            k as (select *, row_number() over (partition by run_id, number order by round(delta, 12), temperature, cand_idx) as r from j)
            select run_id, number, round(original_score, 6) + 0.0 as original_score, temperature as selected_temperature,
              round(score, 6) + 0.0 as selected_score, round(delta, 6) + 0.0 as selected_delta from k where r = 1""",
        "calibration_offset": f"""with {_ARCS}, r as (select slug, run_id, method, arg_min(scores, version) filter (role = 'original') as o,
              min(version) filter (role = 'original') as ov, arg_min(scores, version) filter (role = 'human') as h
              from arcs where method in ('xlm_roberta', 'sw_xlm_roberta') group by all),
            usable as (select *, row_number() over (partition by slug, run_id, substr(ov, 1, 2) order by (method <> 'xlm_roberta')::int) as k from r
              where o is not null and h is not null and (method = 'sw_xlm_roberta' or len(o) = len(h))),
            d as (select case when substr(ov, 1, 2) = 'en' then 'en_to_fr' else 'fr_to_en' end as direction, h[i + 1] - o[i + 1] as x
              from usable, lateral (select unnest(range(least(len(o), len(h)))) as i) where k = 1)
            select direction, round(avg(x), 6) + 0.0 as "offset", count(x) as n_points from d where x is not null group by all""",
        "pending_work": f"""with {_DONE} select chapter_id, run_id, number from chapters c where version like '%\\_original' escape '\\'
            and not exists (select 1 from done where done.run_id = c.run_id and done.number = c.number)""",
        "dry_run": f"""with {_DONE}, m as (select c.slug, c.text, done.run_id is not null as there from chapters c left join done
              on done.run_id = c.run_id and done.number = c.number where version like '%\\_original' escape '\\')
            select slug, count(*) as total, count(*) filter (there) as finished, count(*) filter (not there) as remaining,
              coalesce(sum(length(text)) filter (not there), 0)::bigint as remaining_chars,
              case when count(*) = count(*) filter (there) then 'SKIP' when count(*) filter (there) > 0 then 'COMPLETE' else 'WOULD TRANSLATE' end as status
            from m group by slug""",
        "token_accounting": """select slug, model, count(*) as n, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens
            from candidates group by all""",
        "judge_parse": r"""with p as (select msg_id, try_cast(nullif(regexp_extract(text, '-?\d+(?:\.\d+)?'), '') as double) as v from conversations where text is not null)
            select msg_id, round(case when v is null then 0.0 when v > 10 then 1.0 when v < -10 then -1.0 else v / 10.0 end, 6) + 0.0 as score from p""",
        "strip_boilerplate": f"with {_BODY} select run_id, version, length(t) as chars, md5(t) as digest from bodies",
        "chapter_segmentation": _segmentation(False),
        "chapter_segmentation_expected": _segmentation(True),
        "chapter_validation": """with c as (select slug, count(distinct number) filter (lang = 'fr') as fr, count(distinct number) filter (lang = 'en') as en,
              count(*) filter (lang = 'fr') as has_fr, count(*) filter (lang = 'en') as has_en from chapters group by slug)
            select b.slug, b.title, b.expected_chapters::bigint as expected_chapters, coalesce(fr, 0) as fr, coalesce(en, 0) as en,
              case when coalesce(has_fr, 0) = 0 or coalesce(has_en, 0) = 0 then 'missing' when fr = en and en = expected_chapters then 'ok' else 'differs' end as status
            from books b left join c using (slug)""",
        "chapter_counts": f"""select version, count(*) as n, count(*) filter (char_count <> length(text)) as stale_chars,
            count(*) filter (word_count <> len({_words('text')})) as stale_words from chapters where text is not null group by version""",
        "arc_overlay": f"""with {_ARCS}, {_weights(True)}, {_smoothed('open_arcs', 'scores', keys, True)}
            select m.slug, m.run_id, m.method, m.version, pos, round(case when m.n > 1 then pos * 100.0 / (m.n - 1) else 0.0 end, 6) + 0.0 as x,
              round(scores[pos + 1], 6) + 0.0 as raw, round(y, 6) + 0.0 as smoothed
            from smoothed m join open_arcs w on (m.slug, m.run_id, m.method, m.version) = (w.slug, w.run_id, w.method, w.version)""",
        "arc_drift": f"""with {_ARCS}, {_ROLES} select slug, run_id, method, i as pos, round(human[i + 1] - original[i + 1], 6) + 0.0 as human_drift,
            round(llm[i + 1] - original[i + 1], 6) + 0.0 as llm_drift from roles, lateral (select unnest(range(least(len(original), len(human), len(llm)))) as i)
            where original is not null and human is not null and llm is not null""",
        "metric_heatmap": f"""{_PAIRED}, {_RANKED}, v as (select {_KEY}, {pearson} as pearson_r, {spearman} as spearman_rho, -sqrt(avg((a - b) * (a - b))) as rmse, -avg(abs(a - b)) as mean_abs_diff,
              case when sum(a * a) = 0 or sum(b * b) = 0 then 0.0 else sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) end as cosine_similarity
              from ranked where normalization = 'chapter' and pair in ('original_vs_human', 'original_vs_llm') group by {_KEY}),
            u as (select slug, run_id, method, pair, unnest(['pearson_r', 'spearman_rho', 'rmse', 'mean_abs_diff', 'cosine_similarity']) as metric,
              unnest([pearson_r, spearman_rho, rmse, mean_abs_diff, cosine_similarity]) as x from v)
            select slug, run_id, method, metric, round(max(x) filter (pair = 'original_vs_human'), 6) + 0.0 as orig_human,
              round(max(x) filter (pair = 'original_vs_llm'), 6) + 0.0 as orig_llm from u group by all""",
        "fidelity_scatter": f"""{_PAIRED}, v as (select {_KEY}, {pearson} as r from pp where normalization = 'chapter' group by {_KEY}),
            f as (select slug, run_id, method, max(r) filter (pair = 'original_vs_human') as h, max(r) filter (pair = 'original_vs_llm') as l from v group by all)
            select slug, run_id, method, round(h, 6) + 0.0 as r_orig_human, round(l, 6) + 0.0 as r_orig_llm from f where h is not null and l is not null""",
        "best_of_n_summary": f"with {_CANDIDATES} select n_candidates, count(*) as chapters, round(avg(selected_correlation), 6) + 0.0 as mean_correlation from picked group by all",
    }
