"""SQL twins of the operators for DuckDB: named CTEs that are put together per query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from checks.views import REVIEWS_SQL, SCORED_LINES_SQL, SENTENCES
from reviewlens import constants as K
from reviewlens.functions import text as T

LABELS = K.SENTIMENTS
COLS = K.SCORE_COLUMNS
SPACES = "'" + T.SPACE_CHARACTERS.replace("'", "''") + "'"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values: Sequence[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def num(value: float) -> str:
    return f"{value!r}::double"


def trim(expression: str) -> str:
    return f"trim({expression}, {SPACES})"


def fold(lowered: str) -> str:
    spaced = rf"regexp_replace({lowered}, '[^\p{{L}}\p{{N}}_\x00-\x7F]', ' ', 'g')"
    return rf"regexp_replace({spaced}, '[^\x00-\x7F]', '0', 'g')"


def any_of(lowered: str, keywords: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({lowered}, {lit(k)})" for k in keywords) + ")"


def hits(lowered: str, keywords: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({lowered}, {lit(k)})::int" for k in keywords) + ")"


def not_null(items: str) -> str:
    return f"list_filter({items}, lambda x: x is not null)"


def labels(lowered: str, table: Mapping[str, Sequence[str]]) -> str:
    cases = [f"case when {any_of(lowered, words)} then {lit(label)} end" for label, words in table.items()]
    return not_null("[" + ", ".join(cases) + "]")


def phrases(lowered: str, pairs: Sequence[tuple[str, str]]) -> str:
    cases = [f"case when contains({lowered}, {lit(word)}) then {lit(label)} end" for word, label in pairs]
    return not_null("[" + ", ".join(cases) + "]")


def distinct(items: str) -> str:
    """Distinct list entries in order; ``items`` must be a column."""
    return f"list_filter({items}, lambda x_, n_: list_position({items}, x_) = n_)"


def sentences(text: str, longer_than: int) -> str:
    marked = rf"regexp_replace({trim(text)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: {trim('s')})"
    return f"list_filter({parts}, lambda s: length(s) > {longer_than})"


def words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\s]+')"


def cap_words(text: str, more_than: int, keep: int) -> str:
    w = words(text)
    return f"case when len({w}) > {more_than} then array_to_string({w}[1:{keep}], ' ') || '...' else {text} end"


def anonymise(text: str) -> str:
    """Both neighbours of a match are consumed here, so every pattern is applied twice."""
    for pattern, replacement in T.ANONYMOUS_PATTERNS:
        body = pattern.replace("(", "(?:").replace(" ", r"\s+")
        flags = "g" if pattern in T.CASE_SENSITIVE_PATTERNS else "gi"
        bounded = rf"(^|[^\p{{L}}\p{{N}}_]){body}([^\p{{L}}\p{{N}}_]|$)"
        for _ in range(2):
            text = rf"regexp_replace({text}, {lit(bounded)}, '\1{replacement}\2', '{flags}')"
    return trim(text)


def clamp(value: str, low: float, high: float) -> str:
    return f"greatest({num(float(low))}, least({num(float(high))}, {value}))"


def grade(score: str, position: int, out_of: int = 10) -> str:
    cases = " ".join(f"when {score} >= {num(row[0] * out_of / 10)} then {lit(row[position])}" for row in K.GRADES)
    return f"case {cases} else {lit(K.GRADES[-1][position])} end"


def exact_avg(value: str, where: str = "true") -> str:
    point = f"cast(floor(({value}) * 1000000 + 0.5::double) as bigint)"
    given = f"filter (where {where})" if where != "true" else ""
    return f"(cast(sum({point}) {given} as double) / nullif(count({point}) {given}, 0) / 1000000::double)"


def pct(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then round({part} / {whole} * 100, 2) else 0::double end"


def _pool() -> str:
    rows = ", ".join(f"({i}, {lit(s)})" for i, s in enumerate(SENTENCES))
    return f"select * from (values {rows}) t(pid, txt)"


def token_ctes(prefix: str, source: str, lowered: str, lexicon) -> dict[str, str]:
    """Rule sentiment of ``source`` (review_id, <lowered>): tokens, look-back, probabilities, labels."""
    pos, neg = strings(lexicon.positive), strings(lexicon.negative)
    nots, very = strings(lexicon.negations), strings(lexicon.intensifiers)
    tokens = rf"regexp_extract_all({fold(lowered)}, '\b[a-z'']+\b')"
    p = prefix
    return {
        f"{p}tok": f"select review_id, {tokens} as t from {source}",
        f"{p}word": f"select review_id, unnest(t) as w, generate_subscripts(t, 1) as i from {p}tok",
        f"{p}back": f"""select review_id, case when list_contains({pos}, w) then 1 when list_contains({neg}, w) then -1
             else 0 end as pol,
             lag(w, 1, '') over win as w1, lag(w, 2, '') over win as w2
             from {p}word window win as (partition by review_id order by i)""",
        f"{p}hit": f"""select review_id,
             case when list_contains({nots}, w1) or list_contains({nots}, w2) then -pol else pol end as pol,
             case when (list_contains({very}, w1) and not list_contains({nots}, w1))
                    or (list_contains({very}, w2) and not list_contains({nots}, w2)) then 1.5::double else 1::double end as wt
             from {p}back where pol <> 0""",
        f"{p}sum": f"""select review_id, sum(case when pol = 1 then wt else 0 end) as pos,
             sum(case when pol = -1 then wt else 0 end) as neg from {p}hit group by review_id""",
        f"{p}weights": f"""select s.review_id, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg,
             round(pos / nullif(pos + neg, 0) * 0.8::double, 4) as p, round(neg / nullif(pos + neg, 0) * 0.8::double, 4) as n
             from {source} s left join {p}sum using (review_id)""",
        f"{p}probs": f"""select review_id, pos, neg,
             coalesce(round(p / (p + 0.2::double + n), 4), 0.33::double) as p_pos,
             coalesce(round(0.2::double / (p + 0.2::double + n), 4), 0.34::double) as p_neu,
             coalesce(round(n / (p + 0.2::double + n), 4), 0.33::double) as p_neg from {p}weights""",
        f"{p}sent": f"""select *, case label when 'Positive' then p_pos when 'Neutral' then p_neu else p_neg end as confidence
             from (select review_id, p_pos, p_neu, p_neg,
               case when abs(p_pos - p_neg) < 0.15::double then 'Neutral' when p_pos > p_neg then 'Positive' else 'Negative' end as label,
               round((p_pos - p_neg + 1::double) / 2::double * 10::double, 4) as polarity,
               pos > 0 and neg > 0 and abs(pos - neg) <= 2 as is_mixed from {p}probs)""",
    }


def _aspect_cte() -> str:
    parts = []
    for i, aspect in enumerate(K.ASPECTS):
        positive, negative = K.ASPECT_KEYWORDS[aspect]
        parts.append(f"{hits('low', positive)} as p{i}, {hits('low', negative)} as n{i}")
    return f"select review_id, {', '.join(parts)} from low"


def _aspect_scores() -> str:
    parts = []
    for i in range(5):
        rel = f"least(1::double, (p{i} + n{i}) / 3::double)"
        parts.append(
            f"case when p{i} + n{i} > 0 then {clamp(f'5::double + (p{i} - n{i}) * 2::double', 1, 9)} else 5::double end as s{i}, "
            f"round({rel}, 2) as r{i}, {rel} > 0.15::double as d{i}, "
            f"round(least(1::double, p{i} / 3::double), 2) as ps{i}, round(least(1::double, n{i} / 3::double), 2) as ns{i}"
        )
    return f"select review_id, {', '.join(parts)} from counts"


def blend(polarity: str, score: str, relevance: str) -> str:
    beta = f"least(1::double, {relevance} * 2::double)"
    mixed = f"((1::double - {beta}) * {polarity} + {beta} * {score})"
    return f"round({clamp(f'{num(0.6)} * {mixed} + {num(0.4)} * {polarity}', 0, 10)}, 4)"


def _blended() -> str:
    parts = [f"{blend('s.polarity', f'a.s{i}', f'a.r{i}')} as b{i}" for i in range(5)]
    return f"select review_id, s.*, a.* exclude (review_id), {', '.join(parts)} from sent s join aspects a using (review_id)"


def _scored() -> str:
    weights = [K.REVIEW_WEIGHTS[a] for a in K.ASPECTS]
    overall = " + ".join(f"b{i} * {num(w)}" for i, w in enumerate(weights))
    top = "greatest(" + ", ".join(f"b{i}" for i in range(5)) + ")"
    low = "least(" + ", ".join(f"b{i}" for i in range(5)) + ")"

    def first(value: str) -> str:
        cases = " ".join(f"when b{i} = {value} then {lit(a.lower())}" for i, a in enumerate(K.ASPECTS))
        return f"case {cases} end"

    return f"""select review_id, {clamp("0::double + " + overall, 0, 10)} as overall,
      case when {top} >= 6.5::double then [{first(top)}] else [] end as best,
      case when {low} < 5::double then [{first(low)}] else [] end as worst from blended"""


def _final_labels() -> str:
    return f"""select l.review_id,
      {labels('l.low', K.STRENGTH_SIGNALS)} as s1, {labels('l.low', K.IMPROVEMENT_SIGNALS)} as i1,
      {phrases('l.low', K.STRENGTH_PHRASES)} as s2, {phrases('l.low', K.IMPROVEMENT_PHRASES)} as i2 from low l"""


def top_label_ctes(name: str, source: str, key: str, column: str, top: int = 5) -> dict[str, str]:
    """``name``(key, items): the most frequent list entries per key, ties by first occurrence."""
    return {
        f"{name}_x": f"""select {key}, review_id, unnest({column}) as item, generate_subscripts({column}, 1) as pos
             from {source} where {key} is not null""",
        f"{name}_c": f"""select {key}, item, count(*) as n, min(review_id) as f, arg_min(pos, review_id) as p
             from {name}_x group by {key}, item""",
        f"{name}_r": f"select *, row_number() over (partition by {key} order by n desc, f, p, item) as rn from {name}_c",
        name: f"""select {key}, list(item order by rn) as items from {name}_r where rn <= {top} group by {key}""",
    }


def mode_ctes(name: str, source: str, key: str, column: str) -> dict[str, str]:
    return {
        f"{name}_c": f"""select {key}, {column} as item, count(*) as n, min(review_id) as f from {source}
             where {key} is not null and {column} is not null group by all""",
        name: f"""select {key}, item from {name}_c
             qualify row_number() over (partition by {key} order by n desc, f, item) = 1""",
    }


def entity_ctes(prefix: str, source: str, lists: bool, modes: bool, normalise: bool = True) -> dict[str, str]:
    """``<prefix>entity``: the ranked entity table over a scored ``source`` with teacher_name."""
    p = prefix
    ctes: dict[str, str] = {}
    if lists:
        ctes |= top_label_ctes(f"{p}str", source, "teacher_name", "strengths_list")
        ctes |= top_label_ctes(f"{p}imp", source, "teacher_name", "improvements_list")
    if modes:
        ctes |= mode_ctes(f"{p}sub", source, "teacher_name", "subject")
        ctes |= mode_ctes(f"{p}sem", source, "teacher_name", "semester")
    means = ", ".join(f"round(round({clamp(exact_avg(c), 0, 10)}, 4), 2) as {c}" for c in COLS)
    shares = ", ".join(
        f"{pct(f'count(*) filter (where sentiment_label = {lit(s)})', 'count(*)')} as {s.lower()}_pct" for s in LABELS
    )
    ctes[f"{p}mean"] = f"""select teacher_name, count(*) as total_reviews, {means},
      {exact_avg('confidence')} as mc, {shares},
      count(*) filter (where is_mixed) as mixed_count from {source} where teacher_name is not null group by teacher_name"""
    lo_hi = ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in COLS)
    ctes[f"{p}bounds"] = f"select {lo_hi} from {p}mean"
    scaled = ", ".join(
        f"case when hi_{c} = lo_{c} or not {normalise} then {c} else "
        f"round({clamp(f'({c} - lo_{c}) / (hi_{c} - lo_{c}) * 10', 0, 10)}, 2) end as {c}"
        for c in COLS
    )
    rest = ", ".join([f"{s.lower()}_pct" for s in LABELS] + ["mixed_count", "total_reviews", "mc"])
    ctes[f"{p}scaled"] = f"select teacher_name, {rest}, {scaled} from {p}mean, {p}bounds"
    overall = " + ".join(f"{c} * {num(K.ENTITY_WEIGHTS[a])}" for a, c in K.SCORE_COLUMN.items())
    ctes[f"{p}weighted"] = f"select *, round({clamp('0::double + ' + overall, 0, 10)}, 2) as overall_score from {p}scaled"
    joins, extra = "", []
    for flag, name, column in (
        (modes, f"{p}sub", "subject"), (modes, f"{p}sem", "semester"),
    ):
        if flag:
            joins += f" left join {name} on {name}.teacher_name = o.teacher_name"
            extra.append(f"{name}.item as {column}")
        else:
            extra.append(f"null as {column}")
    for name, column in ((f"{p}str", "strengths"), (f"{p}imp", "improvements")):
        if lists:
            joins += f" left join {name} on {name}.teacher_name = o.teacher_name"
            extra.append(f"coalesce(array_to_string({name}.items, ' | '), '') as {column}")
        else:
            extra.append(f"'' as {column}")
    volume = "least(1::double, total_reviews / 10::double)"
    ctes[f"{p}entity"] = f"""select o.teacher_name, {', '.join(extra)}, total_reviews, {', '.join(COLS)}, overall_score,
      round(mc * (0.6::double + 0.4::double * {volume}), 4) as confidence_score,
      case when mc >= 0.75::double and total_reviews >= 10 then 'High'
           when mc >= 0.55::double and total_reviews >= 3 then 'Medium' else 'Low' end as confidence_band,
      {grade('overall_score', 1)} as grade, {grade('overall_score', 2)} as descriptor,
      positive_pct, neutral_pct, negative_pct, mixed_count,
      row_number() over (order by overall_score desc, o.teacher_name) as rank
      from {p}weighted o{joins}"""
    return ctes


def _filled(value: str, blank: str) -> str:
    return f"case when l.low <> '' then {value} else {blank} end"


def base_ctes() -> dict[str, str]:
    from reviewlens.config import Lexicon

    ctes = {
        "pool": _pool(),
        "raw_reviews": REVIEWS_SQL,
        "reviews": """select *, case when month(date) <= 6 then 'Spring ' else 'Fall ' end || year(date) as semester
             from raw_reviews""",
        "low": f"select *, lower({trim('feedback_text')}) as low from reviews",
    }
    ctes |= token_ctes("", "low", "low", Lexicon())
    ctes["counts"] = _aspect_cte()
    ctes["aspects"] = _aspect_scores()
    ctes["blended"] = _blended()
    ctes["totals"] = _scored()
    ctes["found"] = _final_labels()
    ctes["merged"] = """select review_id,
      list_concat((case when len(s1) > 0 then s1 else best end)[1:5], s2d[1:5]) as s,
      list_concat((case when len(i1) > 0 then i1 else worst end)[1:5], i2d[1:5]) as i
      from (select *, list_filter(s2, lambda x, i: list_position(s2, x) = i) as s2d,
                   list_filter(i2, lambda x, i: list_position(i2, x) = i) as i2d from found) join totals using (review_id)"""
    cols = ", ".join(
        f"{_filled(f'round(b.b{i}, 2)', '0::double')} as {c}" for i, c in enumerate(COLS)
    )
    ctes["scored"] = f"""select l.review_id, l.feedback_text, l.low, l.teacher_name, l.subject, l.semester, l.date, l.rating,
      {_filled('round(o.overall, 2)', '0::double')} as overall_score, {cols},
      {_filled('round(b.confidence, 4)', '0::double')} as confidence,
      {_filled('b.label', "'Neutral'")} as sentiment_label,
      {_filled('b.is_mixed', 'false')} as is_mixed,
      {_filled(f"({distinct('m.s')})[1:5]", '[]')} as strengths_list,
      {_filled(f"({distinct('m.i')})[1:5]", '[]')} as improvements_list,
      {_filled('b.polarity', '5::double')} as polarity,
      {_filled('b.p_pos', '0::double')} as p_pos, {_filled('b.p_neu', '1::double')} as p_neu,
      {_filled('b.p_neg', '0::double')} as p_neg,
      b.* exclude (review_id, label, confidence, is_mixed, polarity, p_pos, p_neu, p_neg)
      from low l join blended b using (review_id) join totals o using (review_id) join merged m using (review_id)"""
    ctes |= entity_ctes("", "scored", True, True)
    ctes |= entity_ctes("plain_", "scored", True, True, normalise=False)
    ctes["lines"] = SCORED_LINES_SQL
    ctes |= entity_ctes("line_", "lines", False, False)
    ctes |= summary_ctes()
    return ctes


def joined_ctes(name: str, source: str, key: str) -> dict[str, str]:
    """Per group: all comments joined, and their sentences of more than 20 characters, comment by comment."""
    text = trim("feedback_text")
    return {
        name: f"""select {key}, coalesce(string_agg({text}, ' ' order by review_id) filter ({text} <> ''), '') as combined,
             coalesce(flatten(list({sentences('feedback_text', 20)} order by review_id) filter ({text} <> '')), []) as chosen
             from {source} where {key} is not null group by {key}"""
    }


def group_summary() -> str:
    """The summary of a row of :func:`joined_ctes`."""
    longer = "case when len(chosen) > 0 then array_to_string(chosen[1:3], ' ') else left(combined, 300) end"
    return f"case when len({words('combined')}) < 25 then combined else {longer} end"


def summary_ctes() -> dict[str, str]:
    """``summaries``(teacher_name, summary, strengths, improvements) over reviews and entity scores times 10."""
    ctes = {
        "phr": f"""select teacher_name, review_id,
             {distinct('s')}[1:5] as s, {distinct('i')}[1:5] as i from (select r.teacher_name, r.review_id,
             {phrases('lower(r.feedback_text)', K.STRENGTH_PHRASES)} as s,
             {phrases('lower(r.feedback_text)', K.IMPROVEMENT_PHRASES)} as i from reviews r)""",
        "volume": "select teacher_name, count(*) as n from reviews where teacher_name is not null group by 1",
    }
    ctes |= top_label_ctes("pstr", "phr", "teacher_name", "s")
    ctes |= top_label_ctes("pimp", "phr", "teacher_name", "i")
    values = ", ".join(
        f"{{'score': case when {c} * 10 > 10 then {c} * 10 / 10 else {c} * 10 end, 'position': {i}, 'aspect': {lit(a)}}}"
        for i, (a, c) in enumerate(K.SCORE_COLUMN.items())
    )
    ctes["ordered"] = f"select teacher_name, list_sort([{values}]) as ordered from entity"
    ctes["poles"] = """select teacher_name, ordered,
      list_transform(list_filter(ordered, lambda a: a.score <= 6.5::double)[1:2], lambda a: a.aspect) as weak,
      list_transform(list_filter(list_reverse(ordered), lambda a: a.score >= 7::double)[1:2], lambda a: a.aspect) as strong
      from ordered"""

    def ranked(name: str, source: str, table: Mapping[str, str], direction: str) -> str:
        cases = " ".join(f"when {lit(label)} then {lit(aspect)}" for label, aspect in table.items())
        return f"""select teacher_name, list(item order by score {direction}, i)[1:3] as items from (
          select x.teacher_name, x.item, x.i, coalesce(o.score, 5::double) as score from
            (select teacher_name, unnest(items) as item, generate_subscripts(items, 1) as i from {source}) x
            left join (select teacher_name, unnest(ordered, recursive := false) as a from ordered) u
              on u.teacher_name = x.teacher_name and u.a.aspect = case x.item {cases} end
            left join lateral (select u.a.score as score) o on true) group by teacher_name"""

    ctes["best3"] = ranked("pstr", "pstr", K.STRENGTH_ASPECT, "desc")
    ctes["worst3"] = ranked("pimp", "pimp", K.IMPROVEMENT_ASPECT, "asc")
    ctes["anon"] = f"""select review_id, teacher_name, {anonymise('feedback_text')} as a from reviews
      where teacher_name is not null and {trim('feedback_text')} <> ''"""
    ctes["sent_x"] = f"""select teacher_name, review_id, unnest(ss) as piece, generate_subscripts(ss, 1) as pos
      from (select teacher_name, review_id, {sentences('a', 15)} as ss from anon)"""
    mention = not_null(
        "[" + ", ".join(
            f"case when {any_of('lower(piece)', kws)} then {lit(a)} end" for a, kws in K.SENTENCE_KEYWORDS.items()
        ) + "]"
    )
    ctes["sent_m"] = f"select *, {mention} as m from sent_x"
    ctes["sent_k"] = """select s.*, case when list_has_any(m, strong) and not list_has_any(m, weak) then 1
      when list_has_any(m, weak) and not list_has_any(m, strong) then 2 else 3 end as kind
      from sent_m s join poles using (teacher_name)"""
    ctes["sent_r"] = """select teacher_name, kind, piece,
      row_number() over (partition by teacher_name, kind order by review_id, pos) as rn from sent_k"""
    ctes["picked"] = """select teacher_name, max(piece) filter (where kind = 1 and rn = 1) as s11,
      max(piece) filter (where kind = 2 and rn = 1) as s21, max(piece) filter (where kind = 3 and rn = 1) as s31,
      max(piece) filter (where kind = 1 and rn = 2) as s12, max(piece) filter (where kind = 2 and rn = 2) as s22
      from sent_r where rn <= 2 group by teacher_name"""
    ctes["whole"] = "select teacher_name, string_agg(a, ' ' order by review_id) as w from anon group by teacher_name"
    ctes["summary_parts"] = f"""select e.teacher_name, v.n, coalesce(w.w, '') as w, array_to_string(
      list_filter([s11, s21, s31, s12, s22], lambda x: x is not null)[1:3], ' ') as chosen
      from entity e join volume v using (teacher_name) left join picked using (teacher_name)
      left join whole w using (teacher_name)"""
    ctes["summary_texts"] = f"""select teacher_name, n, {cap_words('chosen', 75, 75)} as long_text,
      'Based on a limited sample of ' || n || ' reviews, feedback notes that: ' || ({cap_words('w', 60, 60)}) as short_text
      from summary_parts"""
    ctes["summaries"] = f"""select t.teacher_name, case when n < 5 then {cap_words('short_text', 78, 77)}
        else {cap_words('long_text', 78, 77)} end as summary,
      coalesce(array_to_string(b.items, ' | '), '') as strengths,
      coalesce(array_to_string(w.items, ' | '), '') as improvements
      from summary_texts t left join best3 b using (teacher_name) left join worst3 w using (teacher_name)"""
    return ctes


_CTES: dict[str, str] = {}


def half_up(sql: str) -> str:
    """Round the decimal digits of a double half up, as Spark does, in every two-argument ``round``."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i, comma = 1, start + 6, None
        while depth:
            character = sql[i]
            depth += (character in "([{") - (character in ")]}")
            if character == "," and depth == 1:
                comma = i
            if character == "'":
                i = sql.index("'", i + 1)
            i += 1
        out += sql[at:start]
        if comma is None:
            out += f"round({half_up(sql[start + 6 : i - 1])})"
        else:
            value, digits = half_up(sql[start + 6 : comma]), sql[comma + 1 : i - 1].strip()
            out += f"cast(round(cast(cast({value} as varchar) as decimal(38, 18)), {digits}) as double)"
        at = i
    return out + sql[at:]


def compose(final: str, extra: Mapping[str, str] | None = None) -> str:
    """``with`` clause of exactly the CTEs that ``final`` needs, in dependency order."""
    if not _CTES:
        _CTES.update(base_ctes())
    known = {**_CTES, **(extra or {})}
    import re

    def used(sql: str) -> list[str]:
        mentioned = set(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'(?:[^']|'')*'", "''", sql)))
        return [name for name in known if name in mentioned]

    needed: dict[str, None] = {}

    def visit(name: str, seen: tuple[str, ...]) -> None:
        if name in needed or name in seen:
            return
        for inner in used(known[name]):
            if inner != name:
                visit(inner, seen + (name,))
        needed[name] = None

    for name in used(final):
        visit(name, ())
    if not needed:
        return half_up(final)
    parts = ",\n".join(f"{name} as ({half_up(known[name])})" for name in needed)
    return f"with {parts}\n{half_up(final)}"
