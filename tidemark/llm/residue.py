"""Template residue, filler, error pages and script notices in place of content.

Texts are cut into messages, and messages into tokens, with numbers and names as wildcards. A fixed-depth prefix tree
mines the templates of all distinct token sequences of the corpus: its levels are the number of tokens, the leading
tokens and the cue words, which are those that a verdict can rest on; a leaf takes its sequences in order, merges those
that are alike into one template and turns positions that differ into wildcards. As cue words and the number of tokens
are the same all over a leaf, a template's verdict is that of every sequence in it, whatever other texts there are.
Each template is classified once and its verdict goes to all messages of it; a text is excluded where most of what it
says has a bad verdict. Slots that were never filled are looked for apart from that, in every text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.leakage import plain
from tidemark.session import cut, spread

SCHEMA = T.StructType([T.StructField("doc", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("tokens", T.StringType()), T.StructField("leaf", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("slots", T.LongType())])
MINED = T.StructType([T.StructField("sequence", T.LongType()), T.StructField("template_id", T.LongType()), T.StructField("template", T.StringType())])
ANY = "<*>"

#: HTML element names: fixed values. Such tags are markup, any other word in angle brackets is a slot.
ELEMENTS = frozenset(
    "a abbr address article aside audio b base blockquote body br button canvas caption center cite code col colgroup data dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_ .-][A-Za-z0-9]+){0,4}"
CAPITALS, SNAKE = r"[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*", r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+"
#: Every form starts with a literal character, which lets the search skip from one such character to the next.
SLOT = re.compile(
    rf"\{{\{{\s*[\w .|]+\s*\}}\}}|\{{%\s*[\w .|=]+\s*%\}}|\{{(?:[A-Za-z]+(?:_[A-Za-z]+)*|\d{{1,2}})\}}|<%[=-]?\s*[\w .]+\s*%>|<[A-Za-z][A-Za-z0-9]*(?:[_ ][A-Za-z0-9]+){{0,3}}>"
    rf"|\$\{{[\w .]+\}}|\$[A-Z]+(?:_[A-Z]+)*\$|#\{{[\w .]+\}}|\[\[\s*{NAME}\s*\]\]|\[(?:INSERT|insert|Insert)\s[^\[\]]+\]|\[[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+){{0,4}}\]|\[object \w+\]"
    rf"|%\([A-Za-z_]\w*\)[sdifr]|%[A-Za-z]+(?:_[A-Za-z]+)*%|@@[A-Za-z_]+@@|__[A-Za-z]+(?:_[A-Za-z]+)*__|&lt;[A-Za-z][A-Za-z0-9_ ]*&gt;|:[a-z]+(?:_[a-z]+)*:(?![\w/])|\((?:[a-z]+ ){{1,4}}goes here\)"
    rf"|XXX+\b|NaN\b|undefined\b"
    # other wrappings of a field's name, which is told from words by capitals or underscores
    rf"|[«‹⟨⟪〈《【〔｛＜]\s?(?:{CAPITALS}|{SNAKE})\s?[»›⟩⟫〉》】〕｝＞]|<<\s?(?:{CAPITALS}|[a-z]+(?:[_ ][a-z]+)*)\s?>>|\{{[$=:@]\s?[\w.]+\}}|@\{{[\w .]+\}}|\[%-?\s*[\w .]+\s*-?%\]|\(\((?:{CAPITALS}|{SNAKE})\)\)"
    rf"|\*\|[A-Z]\w*\|\*|%%\w+%%|\[{SNAKE}\]|\((?:{SNAKE}|[A-Z]+(?:_[A-Z0-9]+)+)\)|:[A-Z]+(?:_[A-Z]+)+:|\${SNAKE}\b|\$[A-Z]+(?:_[A-Z]+)+\b|([|#=~^!+*]{{1,2}})[A-Z]+(?:_[A-Z]+)+\1|%\d\$[sd]"
)
QUOTED = re.compile(r"`[^`\n]+`")
NAVIGATION = frozenset({"HOME", "FIXTURES", "TABLES", "MENU", "SEARCH", "CONTACT", "EDIT", "SIC", "CITATION NEEDED"})

MESSAGE = re.compile(r"(?<=[.!?…])\s+|\n+|\s\|\s|\s*[{}]\s*|\",\s*\"|\"?[a-z_]+\"\s*:\s*\"?")
TITLE = re.compile(r" \| match cent(?:re|er)", re.I)
ESCAPE = re.compile(r"\\u((?!d[89a-f])[0-9a-f]{4})", re.I)
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)

#: Words of the pseudo-Latin filler family: fixed values.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum ferrum listerna pacrit porrit cordat consec noctem venia tempora oculat amburo malora rudis pellunt dictum quasit vestra solutem minime undabo fauna praebit tellimus valette silentu sagunt cogimus ventrat".split()
)
FILLER = re.compile(
    r"\b(?:dummy|sample|placeholder|filler|body|test) (?:copy|text|paragraph|content)\b|\btest test\b|\basdf\b|\bqwerty\b|\bfoo bar\b|\b(?:text|content|summary|details|more) (?:to follow|coming soon)\b"
    r"|\b(?:your|insert|add|enter) (?:\w+ ){0,3}here\b|\bgoes here\b|\breplace this (?:text|paragraph)\b|\bblindtext\b|\bplatzhalter\b|\btexto de (?:prueba|relleno|teste|exemplo)\b|\btexte (?:de remplissage|factice|d exemple)\b|\bcoming soon\b|\bxx+(?: x+){2,}"
)
def gap(most: int) -> str:
    """At most so many words between two: counted in words, so that a wildcard doesn't change it."""
    return rf"(?: \S+){{0,{most}}}"


SCRIPT = r"(?:java ?script|scripts?|client side scripting|scripting|cookies|ad ?blocker|werbeblocker)"
NOTICE = re.compile(
    rf"\b(?:enable|activate|turn on|switch on|allow|accept|switch off|disable|activer|activez|aktivieren|active|activa|ative|habilite|habilita){gap(7)} {SCRIPT}\b|\b{SCRIPT}{gap(5)} (?:is|are) (?:disabled|required|blocked|turned off)\b|\b{SCRIPT}{gap(7)} aktivieren\b|\b(?:requires?|needs?|necesita|ben[oö]tigt|requiert|requer){gap(4)} {SCRIPT}\b"
    r"|\bturn it on in your browser\b|\b(?:verify|confirm|prove) (?:that )?you are (?:a )?human\b|\bchecking your browser\b|\byour browser is (?:out of date|not supported|outdated)\b|\bbrowser(?: \S+){0,4} cannot run\b|\bthis may take a few seconds\b|\bcaptcha\b|\bsubscribe to (?:continue|keep) reading\b|\bto keep reading\b"
)
CODE = r"(?:4\d\d|5\d\d)"
STATUS = r"(?:not found|forbidden|bad gateway|bad request|gateway time ?out|service unavailable|internal server error|too many requests|access denied|unauthorized|gone|no encontrada|nicht gefunden|introuvable|nao encontrada|acceso denegado|zugriff verweigert|acces refuse|acesso negado|request timeout|payload too large)"
ERROR = re.compile(
    rf"^(?:http |error |fehler |erreur |erro )+{CODE}{gap(10)}$|^(?:http |error |fehler |erreur |erro )*{CODE} {STATUS}\b|^(?:page|seite|pagina) {STATUS}\b|^(?:internal server error|bad gateway|service unavailable|too many requests|gateway time ?out|request timeout|bad request)\b|^(?:\S+ ){{0,5}}{STATUS}(?: {CODE})?$|\berror {CODE}\b|^whoops\b|^oops\b|^sorry\b|\bwe are sorry\b|^an error occurred\b|^unexpected (?:problem|error)\b|^session expired\b|^article unavailable\b"
    r"|\b(?:cannot|could not|can not) be (?:reached|found|loaded|shown|displayed|opened)\b|\bfailed to load\b|\btook too long to (?:answer|respond)\b|\b(?:is )?down for maintenance\b|\bis no longer available\b|\bno longer exists\b|\bexistiert nicht mehr\b|\bcan only be opened by\b|\bhas been (?:removed|deleted|moved)\b|\bwas removed by its publisher\b"
    r"|^(?:erreur|interner? ?(?:server)?fehler|error|erro) intern[eo]\b|\bune erreur est survenue\b|\bein fehler ist aufgetreten\b|\b(?:se ha producido|ha ocurrido|ocorreu) um? ?n? ?erro?r?\b|\bsomething went wrong\b|\bdid not (?:answer|respond) in time\b|\breturned an invalid response\b|\bservers? (?:are|is) busy\b|\bexceeded the (?:request|rate) limit\b|\bsession has (?:timed out|expired)\b|\bsign in again\b|\bdo(?:es)? not have (?:permission|access)\b|\bnot available in your (?:region|country)\b"
    r"|\bno existe o ha cambiado\b|\bsu sesion\b|\bsua sessao\b|\bentre novamente\b|\btrouvee? ou\b|\bn existe (?:plus|pas)\b|\bnicht (?:gefunden|verfugbar)\b|\bretry in a few\b|\bthe (?:server|page|request) (?:encountered|you requested|could not)\b|\baccess (?:is|was|has been)? ?denied$|\byou are not (?:authorized|allowed)\b|\bplease log ?in\b"
)
#: What pages carry besides their message; it speaks for neither side.
FURNITURE = re.compile(
    r"\bmatch cent(?:re|er)$|^(?:loading|reload|contact|search|go back|home|fixtures|tables|menu|details null|status|error|message)\b(?: (?:contact|search|go back|home|fixtures|tables|null|message|error|<\*>|\d+))*$|\b(?:request id|reference|error code)\b|\bnginx\b|\breturn to the home ?page\b|\bzuruck zur startseite\b|\bif the problem persists\b|\bcontact the (?:desk|administrator|editor)\b"
    r"|\bplease try again\b|\btry again later\b|\bcheck the address\b|\bwe are working on it\b|\bhome fixtures tables\b|\bgo back\b|^(?:volver|voltar|retour|zuruck)(?: \S+){0,6}$|^share this\b|^notice$"
)
REPORTED = re.compile(r"\b(?:asked|admitted|said|banner|showed|shows|answered|reported|writes|wrote|used the format|printed|apologised|queued|laugh|remembered|told|replied|captain|supporters|fans|feed answered|stays tbd|notation)\b")


CODES = re.compile(CODE)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


def unfilled_slots(text: str) -> list[str]:
    """Slots in a text that stand where a value belongs. What is quoted in backticks, HTML elements, page navigation
    and format strings that a text speaks of (``%d-%d``, ``{home, draw, away}``, JSON) are none."""
    if not text:
        return []
    found, bare = [], QUOTED.sub(" ", text) if "`" in text else text
    for m in SLOT.finditer(bare):
        slot, before = m[0], bare[max(0, m.start() - 9) : m.start()]
        if slot[0] == "<" and slot[1] != "%" and slot[1:-1].lower() in ELEMENTS:
            continue
        if slot[0] == "[" and slot[1:-1] in NAVIGATION:
            continue
        if slot[0] in "XNu:" and before[-1:] and (before[-1].isalnum() or before[-1] in "_/:"):
            continue
        if slot == "undefined" and before.endswith(("is ", "are ", "was ", "were ", "left ", "remains ")):
            continue
        found.append(slot)
    return found


def untitled(text: str) -> str:
    """The text without page titles of the form ``A - B | Match centre``."""
    out, at = [], 0
    for m in TITLE.finditer(text):
        start = max(at, *(text.rfind(c, at, m.start()) + 1 for c in "\n|<>.!?"))
        if " - " in text[start : m.start()]:
            out += [text[at:start], "\n"]
            at = m.end()
    return "".join([*out, text[at:]]) if out else text


def messages(text: str) -> list[str]:
    """The messages of a text: sentences, lines and fields, without markup."""
    if "\\u" in text:
        text = ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
    return [s for x in MESSAGE.split(untitled(MARKUP.sub("\n", text))) if (s := x.strip(" \t\r\"'|,")) and any(map(str.isalnum, s))]


def tokens(message: str) -> list[str]:
    """Small words; numbers, and capitalised words that don't begin the message, are wildcards, one for a run."""
    shouted = message.isupper()
    out: list[str] = []
    for i, w in enumerate(WORD.findall(message)):
        if w.isalpha() or "'" in w or "’" in w:
            token = ANY if i and w[0].isupper() and not shouted and w.lower() not in KEPT else w.lower()
        else:
            token = w if CODES.fullmatch(w) else ANY
        if token != ANY or not out or out[-1] != ANY:
            out.append(token)
    return out


#: Capitalised words that are no names in such messages.
KEPT = frozenset(
    "javascript cookies error http not found bad gateway service unavailable too many requests gone access denied internal server session expired time out home fixtures tables lorem ipsum id blindtext layout seite gefunden nicht match centre startseite request reference details null code nginx go search contact loading reload "
    "the this that we you your our if please return sorry retry check to in on it an a he she they at for of bitte sie spielbericht spielseite zurück die der das el la los las le les o os as".split()
)


def _literals() -> tuple[frozenset[str], frozenset[str]]:
    """All literal parts of the patterns, and all beginnings of three or more letters of them."""
    spelled = " ".join(re.sub(r"\\[A-Za-z]", " ", x.pattern) for x in (FILLER, NOTICE, ERROR, FURNITURE, REPORTED))
    parts = frozenset(re.findall(r"[a-z]+", spelled)) | LATIN | {"does", "xx", "adblocker"}
    return parts, frozenset(p[:n] for p in parts for n in range(3, len(p) + 1))


LITERALS, BEGINNINGS = _literals()
#: Words of the patterns that are found in any text: no pattern consists of these alone.
PLAIN_WORDS = frozenset("a add an and are as at be by can could did do does for has have if in is it may more no not of on one or out own so that the this to turn up was we with you your un um la le el o e er es re et en de du da der die das the then there they these three".split())


@functools.lru_cache(maxsize=200_000)
def is_cue(token: str) -> bool:
    """Whether a pattern of a verdict could match any of the token: it begins with a literal part of one, or is the
    beginning of one."""
    if token == ANY:
        return False
    return any(w in LITERALS or w in BEGINNINGS or any(w[:n] in LITERALS for n in range(3, len(w))) or CODES.fullmatch(w) or set(w) == {"x"} for w in re.findall(r"[^\W_]+", plain(token)))


def leaf_of(sequence: list[str], depth: int = 3) -> int | None:
    """The leaf of the tree that a sequence belongs to: by its length, ``depth`` leading tokens and its cue words with
    their places. Without a cue word, but for plain ones, there is none: such a sequence is its own template and can only
    be content, or furniture where it has no word at all."""
    cues = [(i, t) for i, t in enumerate(sequence) if is_cue(t)]
    if all(t in PLAIN_WORDS for _, t in cues) and any(t != ANY for t in sequence):
        return None
    return xxhash.xxh64_intdigest("\n".join([str(len(sequence)), *sequence[:depth], "", *(f"{i} {t}" for i, t in cues)])) - 2**63


class Leaf:
    """Templates of one leaf. A sequence joins the most similar template, the first of equal ones, if at least a share
    of ``similarity`` of its positions is equal, and turns the others into wildcards, else it starts its own. Sequences
    come in order, so the templates are the same however the corpus is split into rows or partitions."""

    def __init__(self, similarity: float = 0.7) -> None:
        self.similarity = similarity
        self.templates: list[tuple[int, list[str]]] = []

    def add(self, sequence: int, words: list[str]) -> int:
        """The template's id, which is the id of its first sequence."""
        best, most = None, -1.0
        for candidate in self.templates:
            same = sum(map(str.__eq__, candidate[1], words)) / max(1, len(words))
            if same > most:
                best, most = candidate, same
        if best is not None and most >= self.similarity:
            best[1][:] = [a if a == b else ANY for a, b in zip(best[1], words, strict=True)]
            return best[0]
        self.templates.append((sequence, list(words)))
        return sequence


def grow(frames: Iterator[pd.DataFrame], similarity: float = 0.7) -> Iterator[pd.DataFrame]:
    """Batches of ``leaf, sequence, tokens``, sorted by leaf and tokens, to rows of :data:`MINED`: the template of each
    sequence, and at the end of a leaf its templates. Only the templates of one leaf are kept."""
    at, leaf = None, Leaf(similarity)
    for frame in frames:
        rows: list[tuple] = []
        for key, sequence, text in zip(frame["leaf"].tolist(), frame["sequence"].tolist(), frame["tokens"].tolist(), strict=True):
            if key != at:
                rows += [(None, t, " ".join(w)) for t, w in leaf.templates]
                at, leaf = key, Leaf(similarity)
            rows.append((sequence, leaf.add(sequence, text.split(" ")), None))
        yield _frame(rows, MINED)
    yield _frame([(None, t, " ".join(w)) for t, w in leaf.templates], MINED)


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    """Rows as a frame; whole numbers with gaps stay whole numbers."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema.fields)
    return pd.DataFrame({f.name: pd.array(list(c), dtype="Int64" if isinstance(f.dataType, T.LongType) else "object") for f, c in zip(schema.fields, columns, strict=True)})


@functools.lru_cache(maxsize=100_000)
def classify(template: str) -> str:
    """``filler``, ``notice``, ``error``, ``furniture`` or ``content`` of a template. One that reports something of
    someone is content, whatever it mentions."""
    bare = " ".join(re.findall(r"<\*>|[^\W_]+", plain(template.replace(ANY, " \u0001 ")).replace("\u0001", ANY)))
    words = bare.split()
    if all(w == ANY for w in words):
        return "furniture"
    latin = sum(w in LATIN for w in words)
    if latin >= max(2, 0.5 * len(words)) or (words[0] in {"xxx", "xxxx", "xxxxx", "xx"} and all(set(w) == {"x"} for w in words)):
        return "filler"
    if REPORTED.search(bare):
        return "content"
    if FILLER.search(bare):
        return "filler"
    if NOTICE.search(bare):
        return "notice"
    if ERROR.search(bare):
        return "error"
    if FURNITURE.search(bare):
        return "furniture"
    return "content"


def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of ``doc, text`` to rows of :data:`SCHEMA`: the characters of a text by token sequence, and its slots. A
    sequence's tokens are told once a batch."""
    for frame in frames:
        rows, told, known = [], set(), {}
        for doc, text in zip(frame["doc"].tolist(), frame["text"].tolist(), strict=True):
            text = text or ""
            chars: dict[int, int] = {}
            rows.append((doc, None, None, None, 0, len(unfilled_slots(text))))
            for m in messages(text):
                words = tokens(m)
                spelled = " ".join(words)
                at = xxhash.xxh64_intdigest(spelled) - 2**63
                chars[at] = chars.get(at, 0) + len(m)
                known.setdefault(at, (spelled, words))
            for at, n in chars.items():
                if at in told:
                    rows.append((doc, at, None, None, n, 0))
                else:
                    told.add(at)
                    rows.append((doc, at, known[at][0], leaf_of(known[at][1]), n, 0))
        yield _frame(rows, SCHEMA)


@F.pandas_udf(T.StringType())
def _classify(templates: pd.Series) -> pd.Series:
    return templates.map(classify)


def mined_templates(rows: DataFrame) -> DataFrame:
    """:data:`MINED` over all distinct sequences that have a leaf, of rows told by :func:`tell`."""
    distinct = rows.where("leaf is not null").groupBy("leaf", "sequence").agg(F.min("tokens").alias("tokens"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(parts, "leaf").sortWithinPartitions("leaf", "tokens").select("leaf", "sequence", "tokens").mapInPandas(grow, MINED)


def residue(docs: DataFrame, *, doc_id: str, text: str, least: float = 0.5) -> DataFrame:
    """``doc, slots, filler, notice, error, content`` (characters by verdict) and ``reason`` for each text that is
    residue: one with an unfilled slot (``slot``), or whose bad messages make up at least ``least`` of what isn't page
    furniture (``filler``, ``notice`` or ``error``, whichever is most). Null and empty texts are none; texts of
    furniture alone are none. Whole texts count, whatever their length. Repeated rows of an id are one text."""
    rows = cut(spread(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")).mapInPandas(tell, SCHEMA))
    mined = cut(mined_templates(rows))
    judged = mined.where("template is not null").select("template_id", _classify("template").alias("verdict")).where("verdict != 'content'")
    verdicts = mined.where("sequence is not null").select("sequence", "template_id").join(judged, "template_id").select("sequence", "verdict")
    kinds = ("filler", "notice", "error", "furniture")
    # few sequences have a verdict other than content; AQE broadcasts them where they are small, else splits the rows
    totals = (
        rows.select("doc", "sequence", "chars", "slots").join(verdicts, "sequence", "left").groupBy("doc")
        .agg(F.sum("slots").alias("slots"), F.sum("chars").alias("chars"), *[F.coalesce(F.sum(F.when(F.col("verdict") == k, F.col("chars"))), F.lit(0)).alias(k) for k in kinds])
        .withColumn("content", F.col("chars") - F.col("filler") - F.col("notice") - F.col("error") - F.col("furniture"))
    )
    bad = F.col("filler") + F.col("notice") + F.col("error")
    worst = F.greatest("filler", "notice", "error")
    reason = F.when(F.col("slots") > 0, "slot").when((bad > 0) & (bad >= least * (bad + F.col("content"))), F.when(worst == F.col("filler"), "filler").when(worst == F.col("notice"), "notice").otherwise("error"))
    return totals.select("doc", "slots", "filler", "notice", "error", "content", reason.alias("reason")).where("reason is not null")
