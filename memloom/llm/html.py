"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags, with the path of open tags above it
(names, and words of class, id and role).  Each block is a vector of hashed path words, hashed text words (all of them)
and a few figures; a bidirectional LSTM in numpy reads the sequence both ways, so each block is judged in the context of
the whole page.  Blocks labelled main are joined.

The labeller is trained here, on pages that ``sample_page`` writes: articles of random words inside the usual page
furniture (with class names of several languages, with senseless ones or none, in boxes or in layout tables), with labels
known from the writing.  Training is deterministic and takes seconds on the driver; only the weights (a fixed size) go to
the tasks.

Tags are read in time linear in the page, and a block holds its path as one hashed bit set, so deep nesting, tags without
end and very long pages cost no more than their length.

Defined cases: null html is empty; a page without blocks gives the empty text; unclosed and stray tags are tolerated; a
quote that is never closed ends with its tag; a script, style, textarea or iframe without end takes the rest of the page,
as in browsers; other hidden elements without end hide nothing; repeated rows are labelled alike; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Tags that end a block, tags without an end, and tags whose content is no text. Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe title".split())
#: Hidden elements that take the rest of the page if they have no end; that may hold one another; that may close themselves.
ENDLESS, NESTED, CLOSED = frozenset(("script", "style", "textarea", "iframe")), frozenset(("template", "svg", "math")), frozenset(("svg", "math"))
#: An opening tag of the key ends an open tag of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
GAP = re.compile(r"[\s/]*+")
#: One attribute; a quote without end is part of a bare value.
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
COMMENT_END, WORD = re.compile(r"--!?>"), re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")

PATH_DIM, WORD_DIM, EXTRA, HIDDEN = 256, 32, 7, 16
INPUT = PATH_DIM + WORD_DIM + EXTRA
#: Blocks whose vectors are held at once.
STEP = 4096

Block = tuple[int, str, float]


class Slots(dict):
    """Word -> hashed place, remembered."""

    def __init__(self, places: int):
        super().__init__()
        self.places = places

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = crc32(w.lower().encode()) % self.places
        return self[w]


_PATHS, _SLOTS = Slots(PATH_DIM), Slots(WORD_DIM)


def path_bits(tag: str, names: list[str]) -> int:
    """The hashed path words of one tag."""
    bits = 1 << _PATHS[tag]
    for v in names:
        for w in WORD.findall(v.lower()):
            bits |= 1 << _PATHS[f".{w}"]
    return bits


def read_tag(html: str, at: int) -> tuple[int, str, dict[str, str], bool]:
    """(end, name, class/id/role/href, closes itself) of the tag whose name begins at ``at``; the end lies behind the last sign."""
    m = NAME.match(html, at)
    name, at, n, found = m[0].lower(), m.end(), len(html), {}
    while True:
        gap = GAP.match(html, at)
        at = gap.end()
        if at >= n:
            return n, name, found, False
        if html[at] == ">":
            return at + 1, name, found, gap[0].endswith("/")
        m = ATTRIBUTE.match(html, at)
        at = m.end()
        if (key := m[1].lower()) in ("class", "id", "role", "href"):
            found[key] = m[2] or m[3] or m[4] or ""


class Reader:
    """The blocks of one page."""

    def __init__(self, html: str):
        self.html, self.out = html, []
        self.stack: list[tuple[str, int, int]] = []  # tag, bits of the path, links open
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.chars = self.linked = 0
        self.endless: set[str] = set()  # hidden elements that have no end from here on

    def add(self, raw: str) -> None:
        self.parts.append(unescape(raw) if "&" in raw else raw)
        if size := len(raw.strip()):
            self.chars += size
            if self.stack and self.stack[-1][2]:
                self.linked += size

    def flush(self) -> None:
        if self.parts:
            if text := SPACE.sub(" ", "".join(self.parts)).strip():
                self.out.append((self.stack[-1][1] if self.stack else 0, text, self.linked / max(1, self.chars)))
            self.parts.clear()
        self.chars = self.linked = 0

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def hidden_until(self, tag: str, at: int) -> int:
        """Where the text goes on after a hidden element that begins before ``at``."""
        if tag not in self.endless:
            depth, last = 1, None
            for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+>?" if tag in NESTED else rf"<(/){tag}(?=[\s/>])[^>]*+>?", re.I).finditer(self.html, at):
                if m[1]:
                    depth, last = depth - 1, m.end()
                elif not m[0].endswith("/>"):
                    depth += 1
                if not depth:
                    break
            if last is not None:
                return last
            self.endless.add(tag)
        return len(self.html) if tag in ENDLESS else at

    def start(self, tag: str, attributes: dict[str, str], alone: bool, at: int) -> int:
        if tag == "br":
            self.parts.append(" ")
        elif tag in RAW:
            if tag == "title":
                self.flush()
            return at if alone and tag in CLOSED else self.hidden_until(tag, at)
        else:
            if tag in BLOCK:
                self.flush()
                shut = CLOSES.get(tag, ())
                # Inline tags (links aside) and paragraphs end where a block begins.
                while self.stack and ((top := self.stack[-1][0]) in shut or top == "p" or top not in BLOCK and top != "a"):
                    self.pop()
            if tag not in VOID:
                _, bits, links = self.stack[-1] if self.stack else ("", 0, 0)
                names = [v for k, v in attributes.items() if k != "href"]
                self.stack.append((tag, bits | path_bits(tag, names), links + (tag == "a" and "href" in attributes)))
                self.open[tag] += 1
        return at

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.open[tag]:
            if tag in BLOCK:
                while self.pop() != tag:
                    pass
            else:  # an inline end tag closes no block
                while self.stack and self.stack[-1][0] not in BLOCK and self.pop() != tag:
                    pass

    def read(self) -> list[Block]:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.add(html[at:])
                break
            if lt > at:
                self.add(html[at:lt])
            sign = html[lt + 1 : lt + 2]
            if sign.isascii() and sign.isalpha():
                at, tag, attributes, alone = read_tag(html, lt + 1)
                at = self.start(tag, attributes, alone, at)
            elif sign == "/" and (c := html[lt + 2 : lt + 3]).isascii() and c.isalpha():
                at, tag, _, _ = read_tag(html, lt + 2)
                self.end(tag)
            elif html.startswith("<!--", lt):
                m = COMMENT_END.search(html, lt + 2)
                at = m.end() if m else n
            elif sign and sign in "!?/":
                at = html.find(">", lt) + 1 or n
            else:
                self.add("<")
                at = lt + 1
        self.flush()
        return self.out


def blocks(html: str | None) -> list[Block]:
    """(path bits, text, share of link text) of each leaf block in page order."""
    return Reader(html or "").read()


def features(page: list[Block], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Vectors of the blocks ``lo`` to ``hi`` of a page."""
    mine = page[lo:hi]
    x = np.zeros((len(mine), INPUT), dtype=np.float32)
    raw = np.frombuffer(b"".join([b.to_bytes(PATH_DIM // 8, "little") for b, _, _ in mine]), dtype=np.uint8)
    x[:, :PATH_DIM] = np.unpackbits(raw.reshape(-1, PATH_DIM // 8), axis=1, bitorder="little")
    for i, (_, text, linked) in enumerate(mine):
        words = text.split(" ")
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([_SLOTS[w] for w in words], minlength=WORD_DIM) / len(words)
        letters = sum(map(str.isalpha, text)) / len(text)
        x[i, -EXTRA:] = min(len(text), 1000) / 1000, min(len(words), 60) / 60, letters, text[-1] in ".!?", (lo + i) / len(page), 1 / len(page), linked
    return x


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


def run_cell(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction, and what back-propagation needs."""
    h, c, hs, kept = np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros((len(x), HIDDEN)), []
    into = x @ w[:INPUT] + b
    for t in range(len(x)):
        z = into[t] + h @ w[INPUT:]
        i, f, o, g = sigmoid(z[:HIDDEN]), sigmoid(z[HIDDEN : 2 * HIDDEN]), sigmoid(z[2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[3 * HIDDEN :])
        before, c = c, f * c + i * g
        kept.append((i, f, o, g, before, np.tanh(c), h))
        h = o * np.tanh(c)
        hs[t] = h
    return hs, kept


def back_cell(x, w, kept, dh_all) -> tuple[np.ndarray, np.ndarray]:
    dz_all, dh, dc, prior = np.zeros((len(x), 4 * HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros((len(x), HIDDEN))
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, tc, h = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
        dz_all[t], prior[t] = dz, h
        dh, dc = w[INPUT:] @ dz, dc * f
    return np.vstack([x.T @ dz_all, prior.T @ dz_all]), dz_all.sum(0)


class Labeller:
    def __init__(self, seed: int = 20240305):
        r = np.random.default_rng(seed)
        shape = (INPUT + HIDDEN, 4 * HIDDEN)
        self.p = {"wf": r.normal(0, 0.1, shape), "bf": np.zeros(4 * HIDDEN), "wb": r.normal(0, 0.1, shape), "bb": np.zeros(4 * HIDDEN), "v": r.normal(0, 0.1, 2 * HIDDEN), "a": np.zeros(1)}
        for b in ("bf", "bb"):
            self.p[b][HIDDEN : 2 * HIDDEN] = 1

    def probabilities(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        hf, kf = run_cell(x, self.p["wf"], self.p["bf"])
        hb, kb = run_cell(x[::-1], self.p["wb"], self.p["bb"])
        h = np.hstack([hf, hb[::-1]])
        return sigmoid(h @ self.p["v"] + self.p["a"]), (h, kf, kb)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, (h, kf, kb) = self.probabilities(x)
        d = (p - y) / len(y)
        dh = d[:, None] * self.p["v"]
        wf, bf = back_cell(x, self.p["wf"], kf, dh[:, :HIDDEN])
        wb, bb = back_cell(x[::-1], self.p["wb"], kb, dh[::-1, HIDDEN:])
        return {"wf": wf, "bf": bf, "wb": wb, "bb": bb, "v": h.T @ d, "a": d.sum(keepdims=True)}

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rate: float = 0.01) -> Labeller:
        """Adam, one page a step."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for n, (x, y) in enumerate(pages, 1):
            step = rate * (0.1 + 0.9 * (1 - n / len(pages)))
            for k, g in self.gradient(x, y).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-8)
        return self

    def hidden(self, into: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
        """States of one direction for many pages at once (steps, pages, HIDDEN); ``n``: lengths, falling."""
        h, c, out = np.zeros((len(n), HIDDEN)), np.zeros((len(n), HIDDEN)), np.zeros((*into.shape[:2], HIDDEN))
        for t in range(len(into)):
            m = int(np.searchsorted(-n, -t, side="left"))  # pages that are longer than t
            z = into[t, :m] + h[:m] @ w[INPUT:]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            c = gates[:, HIDDEN : 2 * HIDDEN] * c[:m] + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
            h = gates[:, 2 * HIDDEN :] * np.tanh(c)
            out[t, :m] = h
        return out

    def main_of(self, pages: list[list[Block]]) -> list[list[str]]:
        """The main blocks of each page."""
        out: list[list[str]] = [[] for _ in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
        weights = np.hstack([self.p["wf"][:INPUT], self.p["wb"][:INPUT]]).astype(np.float32)
        lo = 0
        while lo < len(order):
            # Pages of one step hold STEP blocks at most, or are one page, whose vectors are made STEP at a time.
            mine = order[lo : lo + max(1, STEP // len(pages[order[lo]]))]
            lo += len(mine)
            n = np.array([len(pages[i]) for i in mine])
            into_both = np.concatenate([features(pages[i], k, k + STEP) @ weights for i in mine for k in range(0, len(pages[i]), STEP)])
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            step = np.arange(len(into_both)) - np.repeat(at, n)
            page = np.repeat(np.arange(len(n)), n)
            logit = np.full(len(into_both), self.p["a"][0])
            for d, (w, b, place) in enumerate((("wf", "bf", step), ("wb", "bb", n[page] - 1 - step))):
                into = np.zeros((int(n[0]), len(n), 4 * HIDDEN), dtype=np.float32)
                into[place, page] = into_both[:, d * 4 * HIDDEN : (d + 1) * 4 * HIDDEN] + self.p[b]
                logit += self.hidden(into, n, self.p[w])[place, page] @ self.p["v"][d * HIDDEN : (d + 1) * HIDDEN]
            keep = logit >= 0
            for k, i in enumerate(mine):
                out[i] = [text for (_, text, _), q in zip(pages[i], keep[at[k] : at[k] + n[k]], strict=True) if q]
        return out


#: Class names of page furniture and of articles in several languages; training pages use those of one language.
NAMES = {
    "en": {"menu": "menu nav navbar breadcrumb topnav", "header": "header masthead site-header top", "ad": "ad ads advert sponsored promo banner", "side": "sidebar related widget share social", "notice": "cookie notice consent gdpr popup newsletter subscribe alert", "form": "search login form contact", "comments": "comments discussion replies", "comment": "comment reply", "footer": "footer legal copyright", "main": "content article post entry main story text"},
    "de": {"menu": "navigation hauptmenü menü brotkrumen", "header": "kopf kopfzeile kopfbereich", "ad": "werbung anzeige reklame", "side": "seitenleiste verwandt randspalte teilen", "notice": "hinweis zustimmung datenschutz", "form": "suche anmeldung formular", "comments": "kommentare diskussion antworten", "comment": "kommentar antwort", "footer": "fuss fusszeile impressum", "main": "inhalt artikel beitrag text haupttext"},
    "fr": {"menu": "navigation principale fil-ariane", "header": "entete bandeau", "ad": "publicite pub annonce", "side": "barre-laterale connexes partager", "notice": "avis consentement bandeau-cookies", "form": "recherche connexion formulaire", "comments": "commentaires reponses", "comment": "commentaire reponse", "footer": "pied pied-de-page mentions", "main": "contenu article billet texte corps"},
    "es": {"menu": "navegacion menú migas", "header": "cabecera encabezado", "ad": "publicidad anuncio", "side": "barra-lateral relacionados compartir", "notice": "aviso consentimiento", "form": "buscar acceso formulario", "comments": "comentarios respuestas", "comment": "comentario respuesta", "footer": "pie pie-de-pagina", "main": "contenido articulo entrada texto cuerpo"},
}


def sample_page(r: random.Random) -> tuple[str, list[str]]:
    """A page of random words and the blocks of its article."""
    lang = r.choice(["en", "en", "de", "fr", "es"])
    alphabet = {"en": "etaoinshrdlu", "fr": "etaoinshrdluéèàç", "de": "enirstadhuäöüß", "es": "eaosrnidlñóí"}[r.choice(["en", lang, lang])]
    # How boxes are named: by class names, by HTML's own elements alone, by senseless names, or not at all.
    naming = r.choice(["class", "class", "class", "element", "element", "senseless", "none"])
    layout = r.choice(["boxes", "boxes", "boxes", "table"])
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.randint(1, 9)))
    say = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice([".", ".", "", "!"])
    link = lambda s: f'<a href="/{word()}">{s}</a>'
    few = lambda: r.randint(1, 12)
    paragraphs = lambda n: "".join(f"<p>{say(r.randint(1, 60))}</p>" for _ in range(n))

    def box(kind: str, s: str, tag: str = "div") -> str:
        names = NAMES[lang][kind].split()
        if naming == "class":
            return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}">{s}</{tag}>'
        return f'<{tag} class="{word()}{r.randint(0, 99)}">{s}</{tag}>' if naming == "senseless" else f"<{tag}>{s}</{tag}>"

    def links(n: int) -> str:
        items = [link(say(r.choice([1, 1, 2, 5]))) for _ in range(n)]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    own = naming == "element" or r.random() < 0.4  # the furniture's own elements
    furniture = {
        "menu": lambda: f"<nav>{links(few())}</nav>" if own else box("menu", links(r.randint(3, 12))),
        "header": lambda: f"<header><h1>{say(3)}</h1><p>{say(6)}</p></header>" if own else box("header", r.choice([link(say(3)), say(5)]) if naming == "class" else link(say(2))),
        "ad": lambda: box("ad", r.choice([say(few()), paragraphs(1), link(say(4))])) if naming == "class" else f'<div class="ad">{say(few())}</div>',
        "side": lambda: f"<aside>{paragraphs(2)}{links(3)}</aside>" if own else box("side", links(r.randint(3, 12))),
        "notice": lambda: box("notice", paragraphs(1) + f"<button>{word()}</button>") if naming == "class" else f'<div role="dialog" class="cookie">{say(8)}<button>{word()}</button></div>',
        "form": lambda: f"<form><label>{word()}</label><input><select><option>{word()}<option>{word()}</select><button>{say(2)}</button></form>",
        "comments": lambda: r.choice(
            [
                lambda: box("comments", f"<h2>{say(2)}</h2>" + "".join(box("comment", f"<p>{say(r.randint(2, 50))}</p>") for _ in range(r.randint(1, 6))), "section"),
                lambda: box("comments", "".join(f"<li><p>{say(20)}</p></li>" for _ in range(3)), "ol"),
            ]
        )() if naming == "class" else f'<section id="comments"><h3>{say(2)}</h3>' + "".join(f'<div class="comment"><p>{say(r.randint(2, 50))}</p></div>' for _ in range(r.randint(1, 6))) + "</section>",
        "footer": lambda: f"<footer>&copy; {word()}.example &middot; {say(few())}</footer>" if own or naming != "class" else box("footer", r.choice([f"&copy; {say(few())}", say(few()), links(3)])),
    }
    article, body = [], []

    def block(tag: str, n: int) -> None:
        words = say(n).split(" ")
        article.append(" ".join(words))
        if len(words) > 8 and r.random() < 0.2:
            k = r.randrange(len(words))
            words[k] = link(words[k])
        body.append(f"<{tag}>{r.choice(['', '<b>'])}{' '.join(words)}" + (f"</{tag}>" if tag != "p" or r.random() < 0.8 else "<br>"))

    title = say(r.randint(2, 12))
    article.append(title)
    body.append(f"<h1>{title}</h1>")
    for _ in range(r.randint(1, 14)):
        block(r.choice(["p", "p", "p", "p", "p", "h2", "h3", "blockquote", "pre", "figcaption"]), r.randint(1, 90))
        if r.random() < 0.06:
            body.append("<ul>")
            for _ in range(3):
                block("li", r.randint(1, 15))
            body.append("</ul>")
        if r.random() < 0.04:
            body.append("<table>")
            for _ in range(2):
                body.append("<tr>")
                for _ in range(2):
                    block("td", r.randint(1, 6))
                body.append("</tr>")
            body.append("</table>")
        if r.random() < 0.08:
            body.append(furniture[r.choice(["ad", "side", "notice", "form"])]())
    own_main = [lambda s: f"<article>{s}</article>", lambda s: f"<article>{s}</article>", lambda s: f"<main>{s}</main>", lambda s: f"<main><article>{s}</article></main>"]
    boxed = [lambda s: box("main", s), lambda s: box("main", s, "section"), lambda s: box("main", box("main", s))]
    around = r.choice(own_main if naming == "element" else boxed + own_main if naming == "class" else [*boxed, lambda s: s])
    pick = lambda names, p: "".join(furniture[n]() for n in names if r.random() < p)
    above, below = pick(["notice", "header", "menu", "ad", "side"], 0.5), pick(["ad", "side", "comments", "form", "menu", "footer"], 0.5)
    text = around("".join(body) + pick(["comments"], 0.1))
    if layout == "table":
        text = f"<table><tr><td>{furniture['menu']()}</td><td>{text}</td>" + r.choice(["", f"<td>{links(4)}</td>"]) + "</tr></table>"
    html = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{above}{text}{below}"
    return html + r.choice(["</body></html>", ""]), article


def training_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        html, article = sample_page(r)
        page, left = blocks(html), list(article)
        y = np.zeros(len(page))
        for i, (_, text, _) in enumerate(page):
            if left and text == left[0]:
                y[i] = 1
                left.pop(0)
        if page and not left:
            out.append((features(page).astype(np.float64), y))
    return out


_TRAINED: dict[tuple, Labeller] = {}


def trained(pages: int = 1500, seed: int = 1) -> Labeller:
    if (pages, seed) not in _TRAINED:
        _TRAINED[pages, seed] = Labeller().fit(training_pages(pages, seed))
    return _TRAINED[pages, seed]


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", training: int = 1500) -> DataFrame:
    """(key, url, text, n_chars, n_blocks, n_main) for every page; blocks are joined by an empty line."""
    sent = pages.sparkSession.sparkContext.broadcast(trained(training).p)

    @F.pandas_udf("text string, n_blocks int, n_main int")
    def label(s: pd.Series) -> pd.DataFrame:
        model, rows = Labeller(), []
        model.p = sent.value
        for lo in range(0, len(s), 512):
            read = [blocks(h) for h in s.iloc[lo : lo + 512]]
            rows += [("\n\n".join(kept), len(page), len(kept)) for page, kept in zip(read, model.main_of(read), strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_blocks", "n_main"])

    out = pages.select(F.col(key), F.col(url), label(F.col(html)).alias("r"))
    return out.select(key, url, F.col("r.text").alias("text"), F.length("r.text").cast("long").alias("n_chars"), F.col("r.n_blocks").alias("n_blocks"), F.col("r.n_main").alias("n_main"))


def op1_block_labeller(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
