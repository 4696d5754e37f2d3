"""Problem 10."""
import pytest

from silexa.llm import residue as r

BAD = {
    "placeholder": [
        "Dear {{ name }}, your order is on its way.", "Hello ${user.login}!", "Posted by <%= author %>.", "Bonjour [[city]], merci.", "[INSERT date HERE] we open.", "Hi %(name)s", "Hallo <first_name>, schön",
        "%%price%% only", "See {{ url | default }}", "[Your company] is hiring", "Dear __customer__,", "Dear @@shop@@,", "Kosten: {amount}", "Message de <<user>>", "Welcome *|FNAME|*!", "Only {% price %} left", "Since ##date##",
    ],
    "error": ["404 Not Found\nThe requested page /t/1 could not be found on this server.", "<h1>502 Bad Gateway</h1>\n<p>nginx</p>", "Page introuvable. Le sujet demandé n'existe pas.", "Access denied. You do not have permission to view this thread.", "Interner Serverfehler (500). Bitte versuchen Sie es später erneut.",
        "Oops! Something went wrong while loading this page. Request id 12.", "HOPPLA! EIN FEHLER IST AUFGETRETEN.", "Une erreur est survenue. Rechargez la page.", "Se ha producido un error inesperado."],
    "scripts": ["Please enable JavaScript to view this page.", "Bitte aktivieren Sie JavaScript, um diesen Beitrag zu lesen.\n\nPowered by Boards 4.1", "<noscript>You need a browser with scripting switched on to read replies.</noscript>"],
    "filler": ["Lorem ipsum dolor sit amet, amet dolor sed.", "asdf asdf asdf asdf asdf asdf", "This is sample text. It will be replaced before publishing.", "Texte de remplissage. Remplacez ce paragraphe par votre contenu.",
        "TODO describe the product TODO describe the product", "Headline. Text to be provided. Text to be provided.", "Enter a few words about yourself in this field."],
}
GOOD = [
    "In the template I use `{{first_name}}` and it comes out right.", '[code]print("Hello {name}".format(name=user))[/code] fails for me.', "<pre>Dear ${customer}</pre> is my template, what is wrong?",
    "Does anyone know why the board shows a 502 Bad Gateway every night?", "The shop page told me to enable JavaScript, which I did, and now the cart works.", "Our designer left lorem ipsum on the flyer and nobody noticed.",
    "[quote=a]404 Not Found[/quote]\nThat is what we see as well, on both machines, since the weekend.", "> Please enable JavaScript to view this page.\n\nThe valve was replaced on Sunday.", "x wrote:\n> Dear {{name}},\n\nThanks for the photo of the valve.",
    "<blockquote><cite>b</cite> Lorem ipsum dolor sit amet.</blockquote>The kiln is fine again.", "[deleted]", "+1", "bump", "", "The 404 bracket broke after the storm. A friend repaired it with no gloves.",
    "Write your own text there, the sample paragraph looks silly.", "The oak shelf still needs to be oiled. The seller put a crate of tiles in the shed.",
]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_residue_is_told(kind, text):
    assert r.verdict(r.own_lines(text)) == kind
    assert r.evidence(r.own_lines(text))


@pytest.mark.parametrize("text", GOOD)
def test_talk_code_and_quotes_are_not(text):
    assert r.verdict(r.own_lines(text)) is None


def test_nested_and_open_quotes():
    assert r.own_lines("a\n[quote=x]b[quote=y]c[/quote]d[/quote]e[quote=z]never closed") == ["a", "e"]
    assert r.own_lines("[quote=[deleted]]{{name}}[/quote]mine") == ["mine"]
    assert r.own_lines("k wrote:\n> one\n>> two\nmine") == ["mine"]
    assert r.own_lines("so she wrote:\nmine") == ["so she wrote:", "mine"]


def test_code_blocks():
    assert r.without_code("a [code]x{y}[/code] b `c` d") == "a  CODE  b  CODE  d"
    assert r.without_code("</pre>a <pre class=x>b [code] c</pre> d ```e``` f [code]g") == "</pre>a  CODE  d  CODE  f  CODE "
    assert len(r.own_lines("[code" * 100_000 + "<pre>" * 100_000 + "[quote]" * 50_000)) <= 1  # linear, however many are left open


def test_recurrent_lines_are_subtracted(spark):
    page = "Service temporarily unavailable."
    footer = "Riverside boards is a place for people who mend old machines together since the early days of the town"
    docs = [(i, f"Posting {chr(97 + i)} of the series about kilns and valves.\n{footer}", "A", "u", 1) for i in range(10)]
    docs += [(100, f"{page}\n{footer}", "a", "u", 1), (101, f"{page}\nA long own sentence that nobody else ever wrote about this old machine here today", "a", None, 1), (102, None, "a", "u", 1), (103, "", None, "u", 1), (None, page, "a", "u", 1), (104, page, None, None, 1), (104, page, None, None, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, author string, k int")
    assert {(x["doc_id"], x["kind"]) for x in r.residue(df, "doc_id", "text", "source", "author").collect()} == {(100, "error"), (104, "error")}
    # without the counts the footer would be content
    assert r.verdict([page, footer]) is None and r.verdict([page, footer], [False, True]) == "error"
    assert r.residue(df.limit(0), "doc_id", "text", "source", "author").count() == 0


def test_line_form():
    assert r.line_form("heron7 | bench 75 | Tx-246 owner", "heron7") == r.line_form("moss | bench 8 | Ni-1 owner", "moss")


def test_very_long_text():
    text = "word another third. " * 200_000 + "{{name}}"
    assert r.verdict(r.own_lines(text)) == "placeholder"
