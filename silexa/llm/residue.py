"""Template residue, filler, error pages and scripts-required notices (problem 10)."""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: A line is boilerplate of a host if it stands in at least so many of its posts, and in this share of them.
MIN_POSTS, MIN_SHARE = 3, 0.0001

# --- the poster's own text ------------------------------------------------------------------------------------------
_QUOTE_TAG = re.compile(r"\[(/?)quote(?:=(?:[^\[\]\n]|\[[^\[\]\n]*\])*)?\]|<(/?)blockquote[^<>]*>", re.I)
_CODE_TAG = re.compile(r"\[(/?)(code)[^\[\]\n]*\]|<(/?)(pre|code)\b[^<>]*>|(```)|`[^`\n]*`", re.I)
_QUOTED_LINE = re.compile(r"^\s*(?:<p>\s*)?(?:>|&gt;|\|)")
_ATTRIBUTION = re.compile(r"^.{0,80}\b(?:wrote|writes|schrieb|schreibt|écrit|escribió|escribio|dijo|said)\s*:\s*$", re.I)
_MARKUP = re.compile(
    r"</?(?:p|br|b|i|u|s|em|strong|small|hr|h[1-6]|div|span|cite|center|noscript|ul|ol|li|a|img|table|tr|td|font)(?:\s[^<>]*)?/?>"
    r"|\[/?(?:b|i|u|s|url|img|color|size|center|list|\*|spoiler)(?:=[^\[\]\n]*)?\]",
    re.I,
)
_IMAGE = re.compile(r"\[img\][^\[]*\[/img\]|https?://\S+", re.I)
_BREAK = re.compile(r"<br\s*/?>|</?(?:p|h[1-6]|div|hr|li|small)\b[^<>]*>", re.I)


def without_quotes(text: str) -> str:
    """`text` without other posts' words: nested quote blocks, quoted lines and the lines that introduce them.

    A block that is never closed ends with the text.
    """
    out, depth, at = [], 0, 0
    for m in _QUOTE_TAG.finditer(text):
        if depth == 0:
            out.append(text[at : m.start()])
        depth = max(0, depth - 1) if m[1] or m[2] else depth + 1
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    lines = re.split(r"\r\n|\r|\n", "\n".join(out))
    own = []
    for i, line in enumerate(lines):
        if _QUOTED_LINE.match(line):
            continue
        if _ATTRIBUTION.match(line) and any(_QUOTED_LINE.match(x) for x in lines[i + 1 : i + 3]):
            continue
        own.append(line)
    return "\n".join(own)


def without_code(text: str) -> str:
    """`text` with blocks and spans of code replaced by a word; a block that is never closed ends with the text."""
    out, at, name = [], 0, None
    for m in _CODE_TAG.finditer(text):
        tag = (m[2] or m[4] or m[5] or "").lower()
        if name is None:
            if m[1] or m[3]:  # closes nothing
                continue
            out.append(text[at : m.start()] + " CODE ")
            at, name = m.end(), tag or None
        elif tag == name and (m[1] or m[3] or m[5]):
            at, name = m.end(), None
    if name is None:
        out.append(text[at:])
    return "".join(out)


def own_lines(text: str) -> list[str]:
    """The poster's own lines, without code, markup and addresses."""
    s = without_code(without_quotes(text))
    s = _MARKUP.sub("", _BREAK.sub("\n", _IMAGE.sub(" ", s)))
    lines = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in s.split("\n"))
    return [x for x in lines if x and not _FOOTER.match(x)]


#: What closes any page, recurrent or not: copyright, maker, navigation bar.
_FOOTER = re.compile(r"^(?:©|\(c\)|copyright\b|powered by\b)|^[\w ]{1,20}(?: [|·•] [\w ]{1,20}){1,8}$", re.I)


def line_form(line: str, author: str | None) -> str:
    """A line without what differs between posts: the author's name, numbers, product codes, case and punctuation."""
    s = line.replace(author, "@") if author else line
    s = re.sub(r"\d+", "#", s.lower())
    return re.sub(r"[^\w#@]+", " ", re.sub(r"\b[a-z]{2}-#", "#", s)).strip()


# --- evidence -------------------------------------------------------------------------------------------------------
_NAME = r"[A-Za-z][\w.\- ]{0,38}"
#: A name where a value should stand, in the usual notations of template languages.
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{_NAME}\s*(?:\|[^{{}}\n]{{0,40}})?\}}\}}"  # {{name}}, {{ name | default }}
    rf"|[$#]?\{{(?!main\}})\$?\s*{_NAME}\s*\}}"  # {name}, ${name}, #{name}, {$name}
    rf"|<%[=-]?\s*{_NAME}\s*-?%>|<\?=?\s*\$?{_NAME}\s*\?>"  # <%= name %>, <?= $name ?>
    rf"|%%{_NAME}%%|%\({_NAME}\)[sdf]|%[A-Za-z]\w*[._-]?\w*%"  # %%name%%, %(name)s, %name%
    rf"|\[\[\s*{_NAME}\s*\]\]|<<\s*{_NAME}\s*>>"  # [[name]], <<name>>
    rf"|\*\|\s*{_NAME}\s*\|\*|##[A-Za-z][\w.\-]*##|\{{%\s*{_NAME}\s*%\}}|\[%\s*{_NAME}\s*%\]"  # *|name|*, ##name##, {% name %}, [% name %]
    r"|@@[A-Za-z][\w.\-]*@@|@[A-Za-z][\w.\-]*@(?!\w)|__[A-Za-z][\w.\-]*?__|\$[A-Za-z][\w.\-]*\$"  # @@name@@, __name__, $name$
    r"|\[(?:insert|your|ihre?n?|dein|votre|su|tu|inserte|insérer|einfügen)\b [^\]\n]{1,40}\]",  # [INSERT name HERE], [Your name]
    re.I,
)
#: A bare <name> or [name]: a name that is made up of parts, or stands in capitals, and is no markup.
_BARE = re.compile(r"<([A-Za-z][\w.\-]*)>|\[([A-Za-z][\w.\-]*)\]")
_MARKUP_NAMES = frozenset(
    "a abbr article aside b blockquote body br button center cite code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe "
    "img input ins kbd label legend li link main mark meta nav noscript ol option p pre q quote s samp script section select small span strike strong style sub sup table tbody td "
    "textarea tfoot th thead title tr tt u ul url var video color size list spoiler deleted removed sic edit edited update solved ot nsfw gelöscht supprimé eliminado entfernt".split()
)


def _bare_placeholder(s: str) -> bool:
    return any((name := (m[1] or m[2])).lower() not in _MARKUP_NAMES and not name.isdigit() for m in _BARE.finditer(s))


#: How error pages, filler and scripts-required notices begin or read. The talk of people about them is told by TALK.
ERROR = re.compile(
    r"^(?:http )?(?:error|fehler|erreur)?[ :]*[45]\d\d\b|\b(?:error|fehler|erreur|code|status|timeout|\() ?[45]\d\d\b"
    r"|^(?:bad gateway|not found|forbidden|gateway time-?out|internal server error|service (?:temporarily )?unavailable|access denied|permission denied|page not found|"
    r"database error|fatal error|stack trace|server error|session expired|your session|too many requests|request timed? ?out|connection (?:refused|timed out)|an error occurred|"
    r"the (?:requested|upstream|server|page|site|board)\b.*\b(?:not (?:be )?found|unavailable|tim(?:ed|ing) out|error|overloaded|exist|maintenance|down)\b|"
    r"you (?:do not|don't|are not|have no)\b.*\b(?:permission|allowed|authori[sz]ed|access)|uncaught|traceback|warning: \w+\(|seite nicht gefunden|interner serverfehler|zugriff verweigert|"
    r"kein zugriff|dienst nicht verfügbar|datenbankfehler|wartungsarbeiten|der angeforderte|ihre sitzung|sitzung abgelaufen|page introuvable|accès (?:refusé|interdit)|"
    r"erreur (?:interne|du serveur|serveur)|service (?:temporairement )?indisponible|le (?:sujet|serveur|site) demandé|le serveur|base de données|votre session|session expirée|"
    r"página no encontrada|pagina no encontrada|acceso denegado|error (?:interno|del servidor|de base)|servicio no disponible|el servidor|la página|su sesión|sesión (?:caducada|expirada)|"
    r"el tema solicitado|no se (?:ha )?(?:encontrado|pudo)|#\d+ \S+\(\d*\)?|at line \d+|w?h?oops\b|hoppla\b|oups\b)"
    r"|\bsomething went wrong|\b(?:unexpected|unknown|internal) error\b|\ban error (?:has )?occurred|\betwas ist schief ?gegangen|\bein (?:unerwarteter )?fehler ist aufgetreten"
    r"|\bune erreur (?:est survenue|s'est produite)|\bun problème est survenu|\balgo (?:salió|ha salido) mal|\b(?:ha ocurrido|se ha producido|se produjo) un (?:error|problema)",
    re.I,
)
SCRIPTS = re.compile(r"\bjava ?scripts?\b|\bscript(?:s|ing)?\b|\bcookies\b|\bskripte?\b", re.I)
FILLER = re.compile(
    r"^(?:lorem ipsum|dolor sit amet|consectetur|texte? de remplissage|texto de (?:relleno|ejemplo|prueba)|(?:this is|dies ist|ceci est|este es|esto es)\b.{0,20}\b(?:sample|placeholder|filler|dummy|blind|"
    r"platzhalter|remplissage|relleno|ejemplo|prueba|beispiel)|(?:sample|placeholder|filler|dummy|test) text|(?:bitte )?(?:diesen |dies ist ein )?(?:blind|platzhalter|füll|beispiel)text|"
    r"bitte diesen (?:blind|platzhalter)text|(?:please )?(?:replace|insert|add|put) (?:this|your|the) (?:text|content|paragraph)|remplacez ce|ersetzen sie|reemplace este|sustituya este|content goes here|"
    r"(?:your|insert) text here|coming soon|under construction|todo\b|tbd\b|fixme\b)"
    r"|\bto be (?:supplied|provided|added|written|filled in|completed|defined|determined|announced)\b"
    r"|^(?:please )?(?:write|add|enter|type|put|insert|place|describe)\b.{0,60}\b(?:here|in this (?:box|field|space|area|section))\b"
    r"|^(?:bitte )?(?:hier|geben sie|fügen sie|schreiben sie)\b.{0,60}\b(?:ein(?:geben|fügen|tragen)?|in dieses feld)\b|^(?:saisissez|écrivez|ajoutez|escriba|añada|introduzca)\b.{0,60}\b(?:ici|dans ce champ|aquí|en este campo)\b",
    re.I,
)
#: Words by which people speak of themselves, to others, or of a third thing: no page says them.
TALK = re.compile(
    r"\b(?:i|i'm|i've|my|mine|me|anyone|anybody|someone|does|did|our designer|ich|mir|mich|mein\w*|jemand|keinem|wir|j'ai|je|mon|ma|mes|moi|quelqu'un|nous avons|tuve|mi|mis|me|alguien|yo|nuestr\w*)\b",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?…:])\s+")
_TOKEN = re.compile(r"[^\W_]+")


def _repeated(s: str) -> bool:
    """The same few words over and over."""
    w = [x.lower() for x in _TOKEN.findall(s)]
    return len(w) >= 5 and len(set(w)) <= max(1, len(w) // 3)


def kind_of(sentence: str) -> str | None:
    """What a sentence is evidence of, if anything: filler, error or scripts."""
    if FILLER.search(sentence) or _repeated(sentence):
        return "filler"
    if TALK.search(sentence):
        return None
    if SCRIPTS.search(sentence):
        return "scripts"
    return "error" if ERROR.search(sentence) else None


def evidence(lines: list[str]) -> bool:
    """A cheap upper bound: some kind of evidence anywhere in the own text."""
    return any(PLACEHOLDER.search(x) or _bare_placeholder(x) or _repeated(x) or any(kind_of(s) for s in _SENTENCE.split(x)) for x in lines)


#: Words that a page may still have beside each sentence of evidence: in other sentences of its line, and in residual lines without any.
BESIDE, APART = 9, 3


def verdict(lines: list[str], recurrent: list[bool] | None = None) -> str | None:
    """placeholder, error, scripts or filler if the residual lines are that instead of content, else None.

    Lines that are `recurrent` on their host and no evidence themselves are subtracted.
    """
    if any(PLACEHOLDER.search(x) or _bare_placeholder(x) for x in lines):
        return "placeholder"
    kinds: dict[str, int] = {}
    beside = apart = 0
    for line, subtract in zip(lines, recurrent or [False] * len(lines)):
        whole = _repeated(line)
        found, rest, talk = 0, 0, False
        for s in [line] if whole else _SENTENCE.split(line):
            if kind := kind_of(s):
                kinds[kind] = kinds.get(kind, 0) + 1
                found += 1
            else:
                rest += len(_TOKEN.findall(s))
                talk = talk or bool(TALK.search(s))
        if found or not subtract:
            if talk:
                return None
            beside += rest * bool(found)
            apart += rest * (not found)
    n = sum(kinds.values())
    if not kinds or beside > BESIDE * n or apart > APART * n:
        return None
    return max(sorted(kinds), key=lambda k: kinds[k])


# --- the operator ---------------------------------------------------------------------------------------------------
def residue(docs: DataFrame, key: str, text: str, host: str, author: str | None = None) -> DataFrame:
    """Texts that hold template residue, filler, an error page or a scripts-required notice instead of content.

    The poster's own lines (no quotes, code or markup) are brought to a form without names and numbers; each form is
    counted over all texts of its host, in how many texts it stands. Recurrent forms that are no evidence themselves
    (signatures, footers, navigation) are subtracted, and the residual lines decide: an unfilled placeholder anywhere,
    or nothing but error, filler or scripts-required sentences. Returns (key, kind).

    Only hashes of line forms are shuffled for the counts, combined before the shuffle; raw lines go along for texts
    with any evidence only. Null or empty texts are never residue; a null host is a host of its own; rows with a null
    key are left out; other columns are ignored; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[key]
    name = F.col(author) if author else F.lit(None).cast("string")
    src = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.lower(F.coalesce(F.col(host), F.lit(""))).alias("h"), name.alias("a"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, raw = [], []
            for t, a in zip(b.column("t"), b.column("a").to_pylist()):
                lines = own_lines(t.as_py())
                forms.append([line_form(x, a) for x in lines])
                raw.append(lines if evidence(lines) else None)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array(forms, pa.list_(pa.string())), pa.array(raw, pa.list_(pa.string()))], ["k", "h", "forms", "raw"])

    lines = src.mapInArrow(read, f"k {kind}, h string, forms array<string>, raw array<string>")
    lines = staged(lines.select("k", "h", F.transform("forms", lambda x: F.xxhash64(x)).alias("f"), "raw"), "lines")
    posts = lines.groupBy("h").agg(F.count("*").alias("posts"))
    counts = lines.select("h", F.explode(F.array_distinct("f")).alias("f")).groupBy("h", "f").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_POSTS)
    common = counts.join(posts, "h").filter(F.col("n") >= F.col("posts") * MIN_SHARE).select("h", "f", F.lit(True).alias("common"))
    marked = lines.filter(F.col("raw").isNotNull()).select("k", "h", F.posexplode(F.arrays_zip("f", "raw")).alias("at", "x")).select("k", "h", "at", "x.f", "x.raw")
    marked = marked.join(common, ["h", "f"], "left")
    whole = marked.groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("at", "raw", "common"))).alias("x"))
    whole = whole.select("k", F.col("x.raw").alias("raw"), F.transform("x.common", lambda c: F.coalesce(c, F.lit(False))).alias("common"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, common in zip(b.column("raw").to_pylist(), b.column("common").to_pylist()):
                out.append(verdict(raw, common))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.string())], ["k", "kind"])

    return whole.mapInArrow(judge, f"k {kind}, kind string").filter(F.col("kind").isNotNull()).select(F.col("k").alias(key), "kind").distinct()
