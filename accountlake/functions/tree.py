"""Pages as trees: folds over their tags that keep the open elements.

A page is split at ``<``; every piece is a tag and the text behind it. One fold goes over the pieces from front to end
and keeps the path of open elements as a string, ``|html#1#|body#1#|p#3#|``: a name, how many of it lie directly
inside each other, and what that element has to remember. An end tag closes the last element of its name and all that were
left open inside it; one without start tag counts for nothing. Pushing, popping and searching are single string
functions, and runs of elements that are never closed are one entry, so a page costs in proportion to its length.

What the pieces become is collected in blocks of ``BLOCK`` pieces, then joined, as appending to one string would copy it every time.
The folds are written as SQL lambdas: they are long, and building them call by call takes longer than running them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from accountlake import vocab
from accountlake.functions.text import let, let_sql, sql_table

BLOCK = 256
DEEPEST = 4_096  # characters of a path: some hundreds of elements inside each other; tags of deeper ones are read as text without tags

VOID = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source",
    "track", "wbr",
)
# Their insides and end tags are gone by now.
EMPTIED = ("script", "style")


def quoted(values: Iterable[str]) -> str:
    """A list of words as SQL literals."""
    return ", ".join(f"'{v}'" for v in values)


def _written_out(sql: str, names: dict[str, str]) -> str:
    """``sql`` with ``$name`` replaced by what it stands for, which may hold names that come before it."""
    for name, value in reversed(names.items()):
        sql = sql.replace(f"${name}", f"({value})")
    return sql


# A piece x: its text, its tag's lower-case name ("/p" for an end tag, "" for none), whether it opens an element, and how that
# element begins in the path. The analyzer takes some rounds for every lambda inside a lambda, and has a limit of them: values that are
# cheap are written out wherever they are used.
_PIECES = rf"""transform(p, (x, i) -> transform(array(if(i = 0, '', lower(regexp_extract(substring_index(x, '>', 1), r'^/?[A-Za-z][^\s/>|#]*', 0)))), n -> named_struct(
    'x', x, 'i', i, 'name', n, 'key', concat('|', if(startswith(n, '/'), substring(n, 2), n), '#'),
    'opens', n <> '' AND NOT startswith(n, '/') AND n NOT IN ({quoted(VOID + EMPTIED)}) AND NOT endswith(substring_index(x, '>', 1), '/')))[0])"""

# What an end tag closes: what follows its name in the path, how often it is open, and the path before it; then the
# path's last entry, for a start tag.
_NAMES = {
    "pushes": f"x.opens AND octet_length($from) < {DEEPEST}",
    "closes": "startswith(x.name, '/') AND contains($from, x.key)",
    "tail": "substring_index($from, x.key, -1)",
    "times": "cast(substring_index($tail, '#', 1) AS int)",
    "head": "left($from, length($from) - length($tail) - length(x.key) + 1)",
    "last": "substring_index(left($from, length($from) - 1), '|', -1)",
    "again": "$remembered = '' AND startswith($last, substring(x.key, 2)) AND endswith($last, '#')",
}

# The path behind a piece; $remembered is what the element it opens has to remember.
_PATH = """CASE
    WHEN $pushes THEN CASE
        WHEN $again THEN concat(left($from, length($from) - length($last) - 1), substring(x.key, 2),
            cast(cast(substring_index(substring_index($last, '#', 2), '#', -1) AS int) + 1 AS string), '#|')
        ELSE concat($from, substring(x.key, 2), '1#', $remembered, '|') END
    WHEN $closes THEN CASE
        WHEN $times > 1 THEN concat($head, substring(x.key, 2), cast($times - 1 AS string), '#',
            substring_index(substring_index($tail, '|', 1), '#', -1), '|')
        ELSE $head END
    ELSE $from END"""


def _folded(start: dict[str, str], step: str, collected: Sequence[str]) -> str:
    """A fold over all pieces. Of its state s, ``collected`` strings only grow: blocks collect their own and join them."""
    fields = lambda of: ", ".join(f"'{k}', {of(k)}" for k in start)
    empty = fields(lambda k: "''" if k in collected else f"z.{k}")
    joined = fields(lambda k: f"concat(z.{k}, b.{k})" if k in collected else f"b.{k}")
    return f"""transform(array({_PIECES}), q -> aggregate(sequence(0, (size(q) - 1) DIV {BLOCK}), named_struct({fields(start.get)}), (z, n) ->
        transform(array(aggregate(slice(q, n * {BLOCK} + 1, {BLOCK}), named_struct({empty}), (s, x) -> {step})), b -> named_struct({joined}))[0]))[0]"""


# --- where noise, articles and the main part are ---------------------------

# One letter a piece. noise: k kept, t only its text is, - neither. article, main: o opens the (outermost, first) element,
# c it is closed before this piece, - neither.
_STRUCTURE = _written_out(
    """transform(array($path), path -> named_struct(
        'path', path,
        'noise', CASE WHEN $starts THEN length(s.path) WHEN $inside THEN s.noise ELSE -1 END,
        'article', CASE WHEN $live AND $pushes AND x.name = 'article' AND s.article < 0 THEN length(s.path)
            WHEN length(path) <= s.article THEN -1 ELSE s.article END,
        'main', CASE WHEN $live AND $pushes AND x.name = 'main' AND s.main = -1 THEN length(s.path)
            WHEN length(path) <= s.main THEN -2 ELSE s.main END,
        'noises', concat(s.noises, CASE WHEN NOT $live THEN '-' WHEN length(path) = s.noise OR (s.noise < 0 AND $noisy) THEN 't' ELSE 'k' END),
        'articles', concat(s.articles, CASE WHEN $live AND $pushes AND x.name = 'article' AND s.article < 0 THEN 'o'
            WHEN length(path) <= s.article THEN 'c' ELSE '-' END),
        'mains', concat(s.mains, CASE WHEN $live AND $pushes AND x.name = 'main' AND s.main = -1 THEN 'o'
            WHEN length(path) <= s.main THEN 'c' ELSE '-' END)))[0]""",
    {
        "from": "s.path", "remembered": "''", **_NAMES, "path": _PATH,
        "noisy": f"x.key IN ({quoted(f'|{t}#' for t in vocab.NOISE_TAGS)})",
        "inside": "s.noise >= 0 AND length(path) > s.noise",
        "starts": "s.noise < 0 AND $pushes AND $noisy",
        "live": "NOT $inside AND NOT $starts",
    },
)
_START = {"path": "'|'", "noise": "-1", "article": "-1", "main": "-1", "noises": "''", "articles": "''", "mains": "''"}
_LETTERS = ("noises", "articles", "mains")

# SEAM stands before every piece that opens or closes what a row of letters is about.
SEAM = "\x1c"


def _kept(letters: str | None = None) -> str:
    """The pieces without noise, as one text; with ``letters``, a seam at each of them that is not '-'."""
    seam = f"if(substring({letters}, i + 1, 1) = '-', '', '{SEAM}'), " if letters else ""
    return f"""array_join(transform(p, (x, i) -> concat({seam}CASE substring(r.noises, i + 1, 1)
        WHEN 'k' THEN concat(if(i = 0, '', '<'), x)
        WHEN 't' THEN if(contains(x, '>'), substring(x, instr(x, '>') + 1), '') ELSE '' END)), '')"""


def _insides(letters: str) -> str:
    """What the elements hold: they take turns with what lies between them, and start with their tag."""
    return f"""transform(filter(split({_kept(letters)}, '{SEAM}', -1), (x, i) -> i % 2 = 1),
        x -> if(contains(x, '>'), substring(x, instr(x, '>') + 1), ''))"""


_PARTS = f"""p -> transform(array({_folded(_START, _STRUCTURE, _LETTERS)}), r -> named_struct(
    'whole', {_kept()},
    'articles', if(contains(r.articles, 'o'), {_insides('r.articles')}, array_repeat('', 0)),
    'main', if(contains(r.mains, 'o'), {_insides('r.mains')}[0], NULL)))[0]"""


def parts(marked: Column) -> Column:
    """A struct of the page without noise: ``whole``, its outermost ``articles``, and its first ``main`` element (null without one).

    Articles and main come without their own tags. Elements that are never closed reach to the end of the one around them.
    """
    return let_sql(F.split(F.replace(marked, F.lit(SEAM), F.lit("")), "<", -1), _PARTS)


# --- readable text ---------------------------------------------------------

# Marks are single characters until the spaces at their edges are settled; a link's end holds its address.
_MARKS = {"**": ("\x01", "\x02"), "*": ("\x03", "\x04"), "~~": ("\x05", "\x06"), "`": ("\x07", "\x0e")}
_EMPHASIS = {
    "b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`",
}
_LINK, _ADDRESS, _LINK_END = "\x0f", "\x10", "\x11"
_INDENT = "\x12"  # a space a line begins with
_TRIM = "\x13"  # white space behind it goes
_LINE = "\x14"  # a line ends here, if what follows does not begin a new one
_CONTROLS = "".join(c for pair in _MARKS.values() for c in pair) + _LINK + _ADDRESS + _LINK_END + _INDENT + _TRIM + _LINE
BULLETS = "*+-"

_BLOCKS = (
    "p", "div", "article", "section", "ul", "ol", "dl", "dt", "dd", "table", "pre", "figcaption", "hr", "body", "head", "title",
)
_OPENED = {
    **dict.fromkeys(_BLOCKS, "\n\n"), **{f"h{n}": "\n\n" + "#" * n + " " + _TRIM for n in range(1, 7)},
    "blockquote": "\n\n> ", "br": "\n", "/br": "\n", "tr": "\n| ",
}
_CLOSING = {
    **dict.fromkeys(_BLOCKS, "\n\n"), **{f"h{n}": "\n\n" for n in range(1, 7)}, "blockquote": "\n\n", "td": " | ", "th": " | ",
}
_OPEN_MARK = {tag: _MARKS[mark][0] for tag, mark in _EMPHASIS.items()}
_CLOSE_MARK = {tag: _MARKS[mark][1] for tag, mark in _EMPHASIS.items()}
_HREF = r"(?is)^a\s(?:.*?\s)?href\s*=\s*(\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s\x22\x27>]+)"


def _indented(text: str, width: str) -> str:
    """``text`` with every line break followed by so many spaces."""
    return f"if({width} > 0, replace({text}, '\\n', concat('\\n', repeat('{_INDENT}', {width}))), {text})"


def _width(path: str) -> str:
    """The spaces lines have inside the last item of a path. Most pieces lie in none: they are spared the pattern."""
    return rf"if(contains({path}, '|li#'), cast(concat('0', regexp_extract({path}, r'^.*\|li#[0-9]+#([0-9]+)\|', 1)) AS int), 0)"


def _closing(popped: str, width: str) -> str:
    """What the end of elements leaves behind, the last one first; ``width`` is that of the lines after them."""
    href = f"regexp_extract(substring_index(p[cast(substring_index(e, '#', -1) AS int)], '>', 1), r'{_HREF}', 1)"
    one = f"""CASE WHEN startswith(e, 'a#') THEN transform(array({href}),
            h -> if(h = '', '', concat('{_ADDRESS}', btrim(regexp_replace(h, r'^[\\x22\\x27]|[\\x22\\x27]$', '')), '{_LINK_END}')))[0]
        WHEN {width} > 0 AND (startswith(e, 'ul#') OR startswith(e, 'ol#')) THEN concat('{_LINE}', repeat('{_INDENT}', {width}))
        ELSE coalesce(repeat(try_element_at({sql_table(_CLOSE_MARK)}, substring_index(e, '#', 1)),
            cast(substring_index(substring_index(e, '#', 2), '#', -1) AS int)), try_element_at({sql_table(_CLOSING)}, substring_index(e, '#', 1)), '') END"""
    joined = f"array_join(transform(reverse(filter(split({popped}, r'\\|'), e -> e <> '')), e -> {one}), '')"
    return f"if({popped} = '', '', transform(array({joined}), w -> {_indented('w', width)})[0])"


# First the path without the item or link that this one ends by beginning, then with a list's items counted, then behind the piece.
_RENDER = _written_out(
    f"""transform(array(named_struct('path', $before, 'ended', $ended)), u -> transform(array(named_struct('lists', $lists, 'width', $width)), a ->
        transform(array($counted), c -> transform(array(named_struct('path', $path, 'popped', $popped)), l -> named_struct(
            'path', l.path,
            'out', concat(s.out, {_closing("u.ended", "a.width")}, {_closing("l.popped", "$after")}, $made, {_indented("$plain", "$after")})
        ))[0])[0])[0])[0]""",
    {
        "item": "x.opens AND x.name = 'li'",
        "ends": r"""CASE WHEN $item THEN regexp_extract(s.path, r'^.*\|(ul|ol|li)#', 1) = 'li'
            WHEN x.opens AND x.name = 'a' THEN contains(s.path, '|a#') ELSE false END""",
        "inside": "substring_index(s.path, x.key, -1)",
        "before": "if($ends, left(s.path, length(s.path) - length($inside) - length(x.key) + 1), s.path)",
        "ended": "if($ends, concat(substring(x.key, 2), $inside), '')",
        # The list an item belongs to, as it stands in the path, and the spaces lines have inside the items around this piece.
        "lists": r"if($item, regexp_extract(u.path, r'^.*\|((?:ul|ol)#[^|]*)\|', 1), '')",
        "width": _width("u.path"),
        "number": "cast(cast(substring_index(a.lists, '#', -1) AS int) + 1 AS string)",
        "bullet": f"""CASE WHEN startswith(a.lists, 'ol#') THEN concat($number, '. ')
            ELSE concat(substring('{BULLETS}', 1 + pmod(length(u.path) - length(replace(u.path, '|ul#', '|ul')) - 1, 3), 1), ' ') END""",
        "rest": "substring_index(u.path, concat('|', a.lists, '|'), -1)",
        "counted": """if(startswith(a.lists, 'ol#'), concat(left(u.path, length(u.path) - length($rest) - length(a.lists) - 1),
            substring_index(a.lists, '#', 2), '#', $number, '|', $rest), u.path)""",
        "start": r"regexp_extract(substring_index(x.x, '>', 1), r'(?i)\sstart\s*=\s*[\x22\x27]?([0-9]{1,9})', 1)",
        "remembered": """CASE x.name WHEN 'li' THEN cast(a.width + length($bullet) AS string) WHEN 'a' THEN cast(x.i AS string)
            WHEN 'ul' THEN 'u' WHEN 'ol' THEN cast(if($start = '', 0, cast($start AS int) - 1) AS string) ELSE '' END""",
        "from": "c",
        **_NAMES,
        "path": _PATH,
        # What is closed: the element the tag names, and those left open inside it.
        "popped": """CASE WHEN NOT $closes THEN '' WHEN $times > 1 THEN concat(substring(x.key, 2), '1#|', substring($tail, instr($tail, '|') + 1))
            ELSE concat(substring(x.key, 2), $tail) END""",
        "after": _width("l.path"),
        "bare": "x.name = '' AND NOT x.x RLIKE '^[/!?]'",
        "opened": f"coalesce(try_element_at({sql_table(_OPENED)}, x.name), '')",
        "made": f"""CASE
            WHEN x.i = 0 THEN ''
            WHEN $item THEN concat('\\n', repeat('{_INDENT}', a.width), $bullet, '{_TRIM}')
            WHEN x.name IN ('ul', 'ol') AND a.width > 0 THEN ''
            WHEN x.name = 'a' THEN if($pushes AND substring_index(x.x, '>', 1) RLIKE r'{_HREF}', '{_LINK}', '')
            WHEN x.name IN ({quoted(_EMPHASIS)}) THEN if($pushes, try_element_at({sql_table(_OPEN_MARK)}, x.name), '')
            WHEN $bare THEN '<' ELSE {_indented("$opened", "a.width")} END""",
        "words": "if(x.i = 0 OR $bare, x.x, substring(x.x, length(substring_index(x.x, '>', 1)) + 2))",
        "plain": r"if(contains(l.path, '|code#') OR contains(l.path, '|kbd#') OR contains(l.path, '|samp#'), $words, replace(replace($words, '*', '\\*'), '_', '\\_'))",
    },
)
_MARKDOWN = f"""p -> transform(array({_folded({"path": "'|'", "out": "''"}, _RENDER, ("out",))}),
    r -> concat(r.out, {_closing("substring(r.path, 2)", "0")}))[0]"""

_EDGE = f"[ \n{_INDENT}]"
_OPENERS = f"[{''.join(a for a, _ in _MARKS.values())}{_LINK}]"
_ENDS = "".join(b for _, b in _MARKS.values())
_CLOSERS = f"(?:[{_ENDS}]|{_ADDRESS}[^{_LINK_END}]*+{_LINK_END})"
# Marks that follow each other with nothing but white space between and around them: all that can change when they are settled.
# The look ahead passes over letters quickly.
_CLUSTER = rf"((?=[{_EDGE}{_OPENERS}{_ENDS}{_ADDRESS}])(?<!{_EDGE}){_EDGE}*+(?:(?:{_OPENERS}|{_CLOSERS}){_EDGE}*+)++)"
# A cluster without one of these stays as it is.
_UNSETTLED = rf"{_OPENERS}[ \n{_INDENT}{_ENDS}{_ADDRESS}]|{_EDGE}[{_ENDS}{_ADDRESS}]"
# Gone from the text by then: it stands around clusters while they are settled.
_CUT = _TRIM


def _settled(text: Column) -> Column:
    """Marks around what they mark: white space at their edges moves out, or goes with a line break; empty ones go.

    Once for every level of marks inside marks, up to three. Only clusters of marks are looked at, not the copy between them.
    """
    def settle(cluster: Column) -> Column:
        gap = rf"(?<!{_EDGE}){_EDGE}++"
        for _ in range(3):
            for pattern, by in (
                (rf"({_OPENERS}) {_EDGE}*+", " $1"), (rf"({_OPENERS})\n{_EDGE}*+", "$1"),
                (rf"{gap}(?<= )({_CLOSERS})", "$1 "), (rf"{gap}(?<![ ])({_CLOSERS})", "$1"),
                (rf" ?{_OPENERS} ?{_CLOSERS}", ""),
            ):
                cluster = F.regexp_replace(cluster, pattern, by)
        return cluster

    # Clusters take turns with the copy between them.
    parts = F.split(F.regexp_replace(text, _CLUSTER, f"{_CUT}$1{_CUT}"), _CUT, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & x.rlike(_UNSETTLED), settle(x)).otherwise(x)), "")


def _written(text: Column) -> Column:
    """Marks as markdown; a link whose text is its address is written as that."""
    def linked(text: Column) -> Column:
        text = F.regexp_replace(text, rf"{_LINK}([^{_LINK}{_ADDRESS}]+){_ADDRESS}\1{_LINK_END}", "<$1>")
        return F.regexp_replace(F.regexp_replace(text, _LINK, "["), rf"{_ADDRESS}([^{_LINK_END}]*+){_LINK_END}", "]($1)")

    text = let(text, lambda t: F.when(t.contains(_LINK) | t.contains(_ADDRESS), linked(t)).otherwise(t))
    for mark, pair in _MARKS.items():
        for character in pair:
            text = F.replace(text, F.lit(character), F.lit(mark))
    return text


def markdown(fragment: Column) -> Column:
    """Markdown of an HTML fragment whose white space is collapsed, character references undecoded.

    ``INDENT`` stands for the spaces lines inside list items begin with.
    """
    raw = let_sql(F.split(F.regexp_replace(fragment, f"[{_CONTROLS}]", ""), "<", -1), _MARKDOWN)
    trimmed = F.regexp_replace(raw, rf"{_TRIM}{_EDGE}*+", "")
    lines = let(trimmed, lambda t: F.when(t.contains(_LINE), F.replace(
        F.regexp_replace(t, rf"{_LINE}[ {_INDENT}]*+(?=\n|\z|{_LINE})", ""), F.lit(_LINE), F.lit("\n"))).otherwise(t))
    marks = "".join(c for c in _CONTROLS if c not in _INDENT + _TRIM + _LINE)
    return let(lines, lambda text: F.when(text.rlike(f"[{marks}]"), _written(_settled(text))).otherwise(text))


INDENT = _INDENT
