"""DuckDB SQL that says the same as the column functions, for the oracles."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import tells as T
from ..functions.features import EMOJI, TOKEN
from ..functions.text import WORD_CURLY, WORD_STRAIGHT

WS = P.WS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def quotes(x: str) -> str:
    return f"translate({x}, {q('‘’ʼ“”' + chr(0xA0))}, {q(chr(39) * 3 + chr(34) * 2 + ' ')})"


def normalize(x: str) -> str:
    plain = quotes(f"coalesce({x}, '')")
    return trim(f"regexp_replace({plain}, '[ \\t]+', ' ', 'g')")


def words(x: str, curly: bool = True) -> str:
    return f"len(regexp_extract_all({x}, {q(WORD_CURLY if curly else WORD_STRAIGHT)}))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def all_hits(x: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(pattern)}), lambda h: {trim('h')})"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {q(f'([.!?]){WS}+([A-Z0-9' + chr(34) + chr(39) + '(])')}, '\\1' || chr(10) || '\\2', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({marked}, '\\n+'), lambda s: {trim('s')}), lambda s: {words('s')} >= 2)"


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '\\n+'), lambda s: {trim('s')}), lambda s: s <> '')"


def english(x: str) -> str:
    letters = count(x, r"\p{L}")
    return f"({letters} < 20 OR {count(x, '[A-Za-z]')} / {letters} > 0.8)"


def prep(x: str) -> str:
    lowered = f"lower({quotes(f'coalesce({x}, {q(str())})')})"
    return f"regexp_replace(regexp_replace({lowered}, '[0-9]+', '0', 'g'), {q(f'{WS}*{chr(92)}n+{WS}*')}, ' ¶ ', 'g')"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({prep(x)}, {q(TOKEN)})[1:600], lambda t: CASE WHEN regexp_matches(t, {q(EMOJI)}) THEN 'EMO' ELSE t END)"


def fnv(x: str) -> str:
    data = f"list_transform(range(0, len(hex({x})) // 2), lambda i: ('0x' || substr(hex({x}), 2 * i + 1, 2))::BIGINT)"
    return f"list_reduce(list_prepend(2166136261::BIGINT, {data}), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


#: Texts to plant, so that rules have something to find.
PLANTED = [
    "As an AI language model, I delve into the rich tapestry of life — truly, genuinely and deeply. Moreover, it's worth noting that this is a testament to progress.",
    "Let's dive in! Here's the thing: leverage, utilize, harness, foster and elevate your ecosystem to navigate the complexities of the digital landscape.",
    "**Bold claim** about robust, comprehensive and cutting-edge best practices.\n# A heading\n✅ one\n🚀 two\n✅ three\n➡ four",
    "It's not just a tool — it's a game-changer. Whether you're a beginner or an expert, it plays a crucial role. In conclusion, only time will tell.",
    "A stunning, breathtaking, charming and timeless place. Red, white, and blue. Cats, dogs, and birds. Sun, moon and stars. A key, essential, powerful and significant innovation.",
    "Great question! I hope this helps.\nShort line here.\nAnother one.\nAnd more.\nStill going.\nThe end.\nThe result? Nobody is talking about it.",
    "Plain words that say what happened on the day and nothing else.",
    "I'm thrilled to announce a significant step forward. Experts believe the future is bright. In today's fast-paced world we move on -- and on -- and everything in between.",
    "We met at noon and talked for more than an hour about the plan. She said the whole of the work would take two weeks at the most. He thought it might well take all of three weeks if it rained. They agreed to start on Monday morning well before the first rain came. Nobody asked what would happen to them if it snowed instead of that. The meeting ended when the last of the coffee ran out at four by",
]
PLANTED_SQL = f"planted AS (SELECT doc_id, lang, source, coalesce(text, '') || ' ' || list_extract([{', '.join(q(p) for p in PLANTED)}], 1 + doc_id % {len(PLANTED)}) AS text FROM documents)"


#: A quarter of the texts are the last planted one alone, so that their sentences are even.
EVEN_SQL = PLANTED_SQL.replace("planted AS", "original AS", 1) + f", planted AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 4 = 0 THEN {q(PLANTED[-1] + ' ')} || source ELSE text END AS text FROM original)"


def _structural(pattern: str) -> str:
    return P.re2(pattern.replace(r"\S", T.NOT_SPACE), fold=False)


def _rules(name: str, rules: list[P.Rule], first: int) -> str:
    rows = ", ".join(f"({first + k}, {q(r.id)}, {q(r.label)}, {r.weight}::DOUBLE, {r.cap}, {q(r.fix)}, {q(P.re2(r.pattern))})" for k, r in enumerate(rules))
    return f"{name}(ord, id, label, weight, cap, fix, pattern) AS (VALUES {rows})"


def _ruled(rules: str, sample: str) -> str:
    return f"SELECT doc_id, ord, id, label, len(hits) AS count, weight * least(len(hits), cap) AS weight, {sample} AS sample, fix FROM (SELECT doc_id, r.*, list_transform(regexp_extract_all(text, r.pattern), lambda h: {trim('h')}) AS hits FROM norm, {rules} r) WHERE len(hits) > 0"


def _tell(source: str, ord: int, id: str, label: str, count: str, weight: str, sample: str, fix: str, where: str) -> str:
    return f"SELECT doc_id, {ord} AS ord, {q(id)} AS id, {q(label)} AS label, {count} AS count, ({weight})::DOUBLE AS weight, {sample} AS sample, {q(fix)} AS fix FROM {source} WHERE {where}"


def tells_chain(source: str = "planted") -> str:
    """CTEs up to ``tells``: every tell of every normalised text of ``source``, without a gate."""
    cluster_rows = ", ".join(f"({k}, {q(P.re2(p))})" for k, p in enumerate(P.IN_CLUSTERS))
    counts = {
        "t3": count("text", P.re2(P.BY_DENSITY)), "dash": count("text", _structural(T.DASH)), "emo": count("text", _structural(T.EMOJI_LINE)), "heads": count("text", _structural(T.HEADING)),
        "tri": count("text", _structural(T.TRIAD)), "intens": all_hits("text", P.re2(P.INTENSIFIERS)), "promo": all_hits("text", P.re2(P.BROCHURE)), "bolds": all_hits("text", P.re2(T.BOLD, fold=False)),
        "ls": lines("text"), "sl": f"list_transform({sentences('text')}, lambda s: {words('s')}::DOUBLE)",
    }
    brief = f"len(list_filter(ls, lambda l: {words('l')} <= 14 AND len({sentences('l')}) <= 1))"
    cv = "sqrt(n * sq - s * s) / s"
    parts = [
        _ruled("sight", "hits[1]"),
        "SELECT doc_id, 54 AS ord, 'cluster' AS id, 'buzzword cluster' AS label, count(*) AS count, least(1.5 * sum(least(n, 2)), 7)::DOUBLE AS weight, "
        "array_to_string(list(word ORDER BY k)[1:5], ', ') AS sample, 'plain verbs: use, help, build, lead' AS fix FROM words2 GROUP BY doc_id HAVING count(*) >= 2",
        _tell("measured", T._DENSITY, "density", "vague praise density", "t3", "2", "t3 || ' in ' || words || ' words'", "numbers and specifics", "t3 >= 3 AND t3 / words >= 0.025"),
        _tell("measured", T._INTENSE, "intensifier", "hollow intensifiers", "len(intens)", "CASE WHEN len(intens) >= 4 THEN 3 ELSE 2 END", "array_to_string(intens[1:4], ', ')", "cut them", "len(intens) >= 2 AND len(intens) / words >= 0.012"),
        _tell("measured", T._BROCHURE, "promo", "brochure adjectives", "len(promo)", "least(1.5 * len(list_distinct(list_transform(promo, lambda x: lower(x)))), 5)", "array_to_string(promo[1:4], ', ')", "describe, don't sell", "len(list_distinct(list_transform(promo, lambda x: lower(x)))) >= 2"),
        _ruled("phrase", "substr(hits[1], 1, 90)"),
        _tell("measured", T._DASH, "dash", "em-dash density", "dash", "CASE WHEN dash / words * 100 >= 2 THEN 3 ELSE 2 END", "dash || ' dashes'", "commas, periods", "dash >= 2 AND dash / words * 100 >= 0.9"),
        _tell("measured", T._EMOJI, "emoji", "emoji bullets", "emo", "CASE WHEN emo >= 4 THEN 3 ELSE 2 END", "emo || ' lines'", "plain sentences", "emo >= 2"),
        _tell("measured", T._BOLD, "bold", "markdown bold residue", "len(bolds)", "2", "bolds[1]", "no bold", "len(bolds) > 0"),
        _tell("measured", T._HEADING, "heading", "markdown heading residue", "heads", "2", "heads || ' headings'", "no headings", "heads >= 1"),
        _tell(f"(SELECT *, {brief} AS brief FROM measured WHERE len(ls) >= 5)", T._LINES, "broetry", "one-line paragraphs", "len(ls)", "3", "brief || ' of ' || len(ls) || ' lines'", "join into paragraphs", "brief / len(ls) >= 0.75"),
        _tell("(SELECT doc_id, len(sl)::DOUBLE AS n, list_sum(sl) AS s, list_sum(list_transform(sl, lambda x: x * x)) AS sq FROM measured WHERE len(sl) >= 6)", T._RHYTHM, "rhythm", "metronome rhythm", "n::INT", "2", f"'sentence lengths vary by ' || floor({cv} * 100 + 0.5)::BIGINT || '%'", "mix short and long", f"s / n >= 11 AND {cv} < 0.3"),
        _tell("measured", T._TRIAD, "triad", "rule of three", "tri", "1", "tri || ' triads'", "two or four", "tri >= 3 AND tri / words >= 1.0::DOUBLE / 70"),
    ]
    return ",\n".join([
        f"norm AS MATERIALIZED (SELECT doc_id, {normalize('text')} AS text FROM {source})",
        f"measured AS MATERIALIZED (SELECT doc_id, text, {words('text')} AS words, {', '.join(f'{v} AS {k}' for k, v in counts.items())} FROM norm)",
        _rules("sight", P.ON_SIGHT, 0),
        _rules("phrase", P.PHRASES, T._PHRASE),
        f"cw(k, pattern) AS (VALUES {cluster_rows})",
        "words2 AS (SELECT doc_id, k, len(h) AS n, lower(h[1]) AS word FROM (SELECT doc_id, k, regexp_extract_all(text, pattern) AS h FROM norm, cw) WHERE len(h) > 0)",
        "tells AS (" + "\nUNION ALL BY NAME ".join(parts) + ")",
    ])


def analysis_chain(source: str = "planted", sensitivity: str = "balanced") -> str:
    """CTEs up to ``analysis``: doc_id, words, raw, density, exact, n_tells, verdict, skipped; and ``kept``, the tells behind it."""
    slop, suspect = P.SENSITIVITY[sensitivity]
    return tells_chain(source) + f""",
gated AS (SELECT doc_id, text, words, words >= {T.LOWEST_WORDS} AS enough, {english('text')} AS en FROM measured),
kept AS (SELECT t.* FROM tells t JOIN gated USING (doc_id) WHERE enough AND en),
summed AS (SELECT doc_id, sum(weight) AS raw, count(*) AS n_tells FROM kept GROUP BY doc_id),
scored AS (SELECT doc_id, words, enough, en, coalesce(raw, 0) AS raw, coalesce(n_tells, 0) AS n_tells, coalesce(raw, 0) * 100 / greatest(words, {T.DENSITY_WORDS}) AS exact FROM gated LEFT JOIN summed USING (doc_id)),
analysis AS (
  SELECT doc_id, words, floor(raw * 10 + 0.5) / 10 AS raw, floor(exact * 10 + 0.5) / 10 AS density, exact, n_tells,
         CASE WHEN exact >= {slop} AND n_tells >= 2 THEN 'slop' WHEN exact >= {suspect} AND n_tells >= 2 THEN 'suspect' ELSE 'clean' END AS verdict,
         CASE WHEN enough AND NOT en THEN 'not english' END AS skipped
  FROM scored)"""
