"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM in numpy over a page's leaf blocks.

A page is read into blocks, the runs of text between block-level tags; each has its tag path with class, id and role
words, its own words and a few statistics, all hashed. The network reads the sequence of blocks from both ends and
labels every block as article text or not. It is trained here, with a fixed seed, on pages that `practice` lays out:
layouts and their names are chosen at random and words are made up, so no row of any table is an input of learning.

Character references are decoded, white space inside a block becomes one space, blocks that stay are joined in page
order by two newlines. Whole pages are read, however long; a page's blocks are scored as one sequence. Null html counts
as empty and gives an empty text; so does a page without article text. What follows an unclosed comment, script or tag
is part of it and no text. Repeated rows are read alike; null ids and urls stay null. An empty table gives an empty
result; other columns of the table are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

PATHS, WORDS, STATS, HIDDEN = 512, 128, 7, 16
INPUTS = PATHS + WORDS + STATS
PRACTICE_PAGES, EPOCHS, BATCH_BLOCKS = 1500, 16, 20_000
#: Quotes enclose a value where it begins with one; elsewhere, as in title=it's, they are characters of it.
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=++)*+)>""")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead title tr ul".split()
)
#: What an opening tag ends, and the tags beyond which it does not look for it.
_ENDS = {t: ({"p"}, {"td", "th", "table", "button"}) for t in _BLOCK if t not in ("button", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot")}
_ENDS |= {"li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Reader:
    """Builds the blocks of one page: [(text, path tokens, characters inside links)]."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.count: dict[str, int] = {}
        self.blocks: list[tuple[str, tuple[str, ...], int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = dict.fromkeys(x for _, names in self.open for x in names)
            if self.open:
                path["last:" + next((t for t, _ in reversed(self.open) if t in _BLOCK), "")] = None
            self.blocks.append((text, tuple(path), self.linked))
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            decoded = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(decoded)
            if self.count.get("a"):
                self.linked += len(decoded.strip())

    def pop(self, upto: int) -> None:
        if any(t in _BLOCK for t, _ in self.open[upto:]):
            self.flush()
        for t, _ in self.open[upto:]:
            self.count[t] -= 1
        del self.open[upto:]

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in _BLOCK:
            self.flush()
        ends, walls = _ENDS.get(tag, ((), ()))
        if any(self.count.get(t) for t in ends):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in walls:
                    break
                if self.open[k][0] in ends:
                    self.pop(k)
                    if tag not in ("li", "dt", "dd", "tr"):
                        break
        if tag in _VOID:
            return
        names = [tag]
        for m in _NAMED.finditer(attributes):
            names += ["@" + w for w in _PART.findall((m[2] or m[3] or m[4] or "").lower())]
        self.open.append((tag, tuple(names)))
        self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if self.count.get(tag):
            k = len(self.open) - 1
            while self.open[k][0] != tag:
                if tag not in _BLOCK and self.open[k][0] in _BLOCK:
                    return  # an inline tag ends nothing beyond its block
                k -= 1
            self.pop(k)
        elif tag in _BLOCK:
            self.flush()


def blocks_of(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path tokens, characters inside links) of the blocks of a page, in order."""
    reader, at, n = _Reader(), 0, len(page)
    while at < n:
        to = page.find("<", at)
        if to < 0:
            reader.text(page[at:])
            break
        nxt = page[to + 1 : to + 2]
        if not (nxt.isascii() and nxt.isalpha()) and nxt not in ("/", "!", "?"):
            to = page.find("<", to + 1)
            to = n if to < 0 else to
            reader.text(page[at:to])
            at = to
            continue
        reader.text(page[at:to])
        if nxt in ("!", "?"):
            close = "-->" if page.startswith("<!--", to) else ">"
            end = page.find(close, to + (4 if close == "-->" else 1))
            at = n if end < 0 else end + len(close)
        elif nxt == "/":
            end = page.find(">", to)
            name = re.match(r"[a-zA-Z][^\s/>]*", page[to + 2 : to + 66])
            if name and end >= 0:
                reader.end(name[0].lower())
            at = n if end < 0 else end + 1
        else:
            m = _TAG.match(page, to)
            if not m:
                break
            tag, at = m[1].lower(), m.end()
            if tag in _RAW and not m[2].endswith("/"):
                end = _RAW[tag].search(page, at)
                at = n if not end else end.start()
                if at < n:
                    at = page.find(">", at) + 1 or n
            else:
                reader.start(tag, m[2])
                if m[2].endswith("/") and tag not in _BLOCK and tag not in _VOID:
                    reader.end(tag)
    reader.flush()
    return reader.blocks


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % size


def encode(blocks: list[tuple[str, tuple[str, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, values, bounds) of the blocks: sparse rows over INPUTS."""
    inputs: list[int] = []
    values: list[float] = []
    bounds = [0]
    known: dict[tuple[str, ...], list[int]] = {}
    for text, path, linked in blocks:
        if path not in known:
            known[path] = sorted({_bucket(x, PATHS) for x in path})
        inputs += known[path]
        values += [1.0] * len(known[path])
        words = text.lower().split()
        own: dict[int, int] = {}
        for w in words:
            k = PATHS + _bucket(w.strip(".,;:!?()\"'"), WORDS)
            own[k] = own.get(k, 0) + 1
        norm = sum(x * x for x in own.values()) ** 0.5 or 1.0
        inputs += own
        values += [x / norm for x in own.values()]
        size = len(text)
        inputs += range(PATHS + WORDS, INPUTS)
        values += [
            min(linked / size, 1.0), np.log1p(size) / 6, np.log1p(len(words)) / 5, min(1.0, 10 * sum(map(text.count, ".,;")) / size), 1.0 * (text[-1] in ".!?"),
            1.0 * (text[0] in "©"), min(1.0, sum(c.isdigit() for c in text) / size),
        ]
        bounds.append(len(inputs))
    return np.array(inputs, np.int32), np.array(values, np.float32), np.array(bounds, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM of HIDDEN cells each way and a logistic output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        self.p = {"o": draw(2 * HIDDEN), "ob": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {"x" + way: draw(INPUTS, 4 * HIDDEN), "h" + way: draw(HIDDEN, 4 * HIDDEN), "c" + way: np.zeros(4 * HIDDEN, np.float32)}
            self.p["c" + way][HIDDEN : 2 * HIDDEN] = 1.0  # cells start by remembering

    def _run(self, way: str, pre: np.ndarray, mask: np.ndarray, keep: bool):
        """States of (time, page, HIDDEN) and what the way back needs; `b` reads from the end."""
        steps, pages, _ = pre.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + way]
            gate = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            s = np.tanh(new)
            if keep:
                tape.append((t, i, f, o, g, c, s, h))
            c, h = np.where(m, new, c), np.where(m, o * s, h)
            states[t] = h
        return states, tape

    def _back(self, way: str, tape, grad: np.ndarray, mask: np.ndarray):
        """(gradient of the pre-activations, gradient of the recurrent matrix)."""
        out, rec = np.zeros((*grad.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.p["h" + way])
        dh, dc = np.zeros(grad.shape[1:], np.float32), np.zeros(grad.shape[1:], np.float32)
        for t, i, f, o, g, c, s, h in reversed(tape):
            m = mask[t][:, None]
            dh = dh + grad[t]
            own = np.where(m, dh, 0)
            cell = np.where(m, dc, 0) + own * o * (1 - s * s)
            z = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), own * s * o * (1 - o), cell * i * (1 - g * g)], axis=1)
            out[t] = z
            rec += h.T @ z
            dh = np.where(m, 0, dh) + z @ self.p["h" + way].T
            dc = np.where(m, cell * f, dc)
        return out, rec

    def _pre(self, way: str, inputs, values, bounds) -> np.ndarray:
        """The blocks' gate inputs, from sparse rows."""
        if bounds.size == 1:
            return np.zeros((0, 4 * HIDDEN), np.float32)
        return np.add.reduceat(self.p["x" + way][inputs] * values[:, None], bounds[:-1], axis=0) + self.p["c" + way]

    def fit(self, pages: list[list], labels: list[list[int]]) -> Labeller:
        data = [encode(p) for p in pages]
        rng, step = np.random.default_rng(3), 0
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            order = order[np.argsort([len(labels[k]) // 8 for k in order], kind="stable")]
            runs = [order[a : a + 28] for a in range(0, len(order), 28)]
            for k in rng.permutation(len(runs)):
                use = runs[k]
                steps = max(len(labels[r]) for r in use)
                x = np.zeros((steps, use.size, INPUTS), np.float32)
                y, mask = np.zeros((steps, use.size), np.float32), np.zeros((steps, use.size), bool)
                for j, r in enumerate(use):
                    inputs, values, bounds = data[r]
                    x[np.repeat(np.arange(bounds.size - 1), np.diff(bounds)), j, inputs] = values
                    y[: len(labels[r]), j], mask[: len(labels[r]), j] = labels[r], True
                flat = x.reshape(-1, INPUTS) * (rng.random((steps * use.size, INPUTS), dtype=np.float32) > 0.05)
                flat[:, PATHS:] *= rng.random((steps * use.size, 1)) > 0.4  # neither a name nor the words may be all that tells
                run = {w: self._run(w, (flat @ self.p["x" + w] + self.p["c" + w]).reshape(steps, use.size, -1), mask, True) for w in "fb"}
                both = np.concatenate([run["f"][0], run["b"][0]], axis=2)
                error = np.where(mask, _sigmoid(both @ self.p["o"] + self.p["ob"]) - y, 0) / mask.sum()
                grads = {"o": (both * error[:, :, None]).sum(axis=(0, 1)), "ob": np.array([error.sum()])}
                for w, a in (("f", 0), ("b", HIDDEN)):
                    z, grads["h" + w] = self._back(w, run[w][1], error[:, :, None] * self.p["o"][a : a + HIDDEN], mask)
                    z = z.reshape(-1, 4 * HIDDEN)
                    grads["x" + w], grads["c" + w] = flat.T @ z, z.sum(axis=0)
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS)
                for name, g in grads.items():
                    m, q = moments[name]
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    self.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, pages: list[list]) -> list[np.ndarray]:
        """Of each page its blocks' probabilities of being article text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        while order:
            most = len(pages[order[0]])
            use = [order.pop(0)]
            while order and len(pages[order[0]]) * (len(use) + 1) <= BATCH_BLOCKS and len(pages[order[0]]) <= 2 * most:
                use.append(order.pop(0))
            steps = max(len(pages[k]) for k in use)
            mask = np.arange(steps)[:, None] < np.array([len(pages[k]) for k in use])
            data = [encode(pages[k]) for k in use]
            states = []
            for w in "fb":
                pre = np.zeros((steps, len(use), 4 * HIDDEN), np.float32)
                for j, row in enumerate(data):
                    pre[: row[2].size - 1, j] = self._pre(w, *row)
                states.append(self._run(w, pre, mask, False)[0])
            total = _sigmoid(np.concatenate(states, axis=2) @ self.p["o"] + self.p["ob"])
            for j, k in enumerate(use):
                out[k] = total[: len(pages[k]), j]
        return out


#: Names and phrases of page parts that are no article, for the practice pages.
_ASIDES = {
    "nav": ("nav menu navbar navigation breadcrumb topnav", "Home About Contact Login Products News Search Help Archive"),
    "header": ("header masthead banner topbar siteheader branding", "Welcome Site Search Login Menu"),
    "footer": ("footer bottom colophon copyright legal", "© 2024 All rights reserved. Privacy Terms Contact Imprint"),
    "aside": ("sidebar aside related widget recommended trending popular", "Related Popular Read more Trending Latest posts"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo banner", "Advertisement Sponsored Buy now Sale offer"),
    "notice": ("cookie consent notice alert gdpr banner popup modal newsletter", "We use cookies. Accept all Settings Subscribe to our newsletter"),
    "form": ("form search subscribe login signup newsletter", "Name Email Password Submit Search Subscribe Sign up"),
    "comments": ("comments comment responses discussion replies disqus", "Comments Reply says: Leave a reply Report posted"),
    "share": ("share social sharing toolbar tags", "Share Tweet Facebook Print Email"),
}
_MAIN = "article content main post entry story body text page maincontent articlebody postcontent".split()


def practice(seed: int) -> tuple[str, set[str]]:
    """(html, texts of the article's blocks) of a made-up page."""
    rng = np.random.default_rng([seed, 41])
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    made = lambda: "".join(pick("an ber co dé el fi go ha in ko lu ma no or pa ré si tu ul wa th er st ing".split()) for _ in range(int(rng.integers(1, 5))))
    words = lambda a, b: " ".join(made() for _ in range(int(rng.integers(a, b))))

    def prose() -> str:
        return " ".join(words(1, 14).capitalize() + pick([".", ".", "?", ",", ""]) for _ in range(int(rng.integers(1, 6))))

    def junk(kind: str, own: bool) -> str:
        names, phrases = _ASIDES[kind]
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = semantic if semantic and own else pick(["div", "div", "section", "aside"])
        named = "" if tag == semantic and rng.random() < 0.6 else f' {pick(["class", "class", "id"])}="{pick(names.split())}{pick(["", "", "-box", " wide", "-1"])}"'
        said = lambda: pick([" ".join(pick(phrases.split()) for _ in range(int(rng.integers(1, 5)))), words(1, 5), prose()])
        if kind in ("nav", "header", "share") or kind in ("footer", "aside") and rng.random() < 0.5:
            item = lambda: f'<a href="/{made()}">{pick([made(), said()])}</a>'
            inner = "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(int(rng.integers(1, 7)))) + "</ul>" if rng.random() < 0.7 else " ".join(item() for _ in range(int(rng.integers(1, 5))))
            if kind == "header" and rng.random() < 0.6:
                inner = "<{0}>{1}</{0}>".format(pick(["h1", "h2", "div", "p"]), words(1, 4)) + pick(["", inner])
        elif kind == "form":
            inner = "".join(f"<{t}>{said()}</{t}>" for t in (pick(["label", "p", "button", "legend"]) for _ in range(int(rng.integers(1, 4)))))
        else:
            inner = "".join(pick(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "{}", "<h3>{}</h3>", "<li>{}</li>"]).format(pick([said(), prose(), prose()])) for _ in range(int(rng.integers(1, 4))))
        if kind == "comments":
            inner = "".join(f'<{pick(["div", "li", "article"])} class="comment">{pick(["", f"<b>{made()}</b>"])}<p>{prose()}</p></div>' for _ in range(int(rng.integers(1, 4))))
        return f"<{tag}{named}>{inner}</{tag}>"

    kept: set[str] = set()
    phrases = [x for _, x in _ASIDES.values()]

    def keep(text: str, form: str) -> str:
        kept.add(" ".join(text.split()))
        return form.format(text)

    body = [keep(words(2, 12).capitalize(), pick(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]))] if rng.random() < 0.9 else []
    for _ in range(int(rng.integers(1, 12))):
        form = pick(["<p>{}</p>"] * 7 + ["<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", '<p><a href="/x">{}</a></p>'])
        saying = words(2, 6) if form[1] == "h" else pick([prose(), prose(), prose(), words(1, 4), " ".join(pick(pick(phrases).split()) for _ in range(int(rng.integers(1, 6)))) + pick([".", ""])])
        body.append(keep(saying, form))  # an article may say what menus and footers say
        if rng.random() < 0.1:
            body.append(junk(pick(["ad", "aside", "notice", "form", "share"]), rng.random() < 0.6))
    if rng.random() < 0.2:
        body.append(junk(pick(["comments", "share"]), True))
    inner = "".join(body)
    layout = rng.random()
    if layout < 0.6:
        whole = f"<article>{inner}</article>"
        whole = pick([whole, whole, f"<main>{whole}</main>", f'<div class="{pick(_MAIN)}">{whole}</div>'])
    elif layout < 0.75:
        whole = f"<main>{inner}</main>"
    else:
        whole = f'<div {pick(["class", "id"])}="{pick(_MAIN)}">{inner}</div>'
    above = [junk(pick(["nav", "nav", "header", "ad", "notice", "aside", "form"]), rng.random() < 0.7) for _ in range(int(rng.integers(0, 4)))]
    below = [junk(pick(["footer", "footer", "comments", "aside", "ad", "form", "notice", "share"]), rng.random() < 0.7) for _ in range(int(rng.integers(0, 4)))]
    return f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(above)}{whole}{''.join(below)}{pick(['', '</body></html>'])}", kept


@functools.cache
def learn(pages: int = PRACTICE_PAGES) -> Labeller:
    """The labeller of that many practice pages; always the same for the same number, and learned once in a process."""
    blocks, labels = [], []
    for k in range(pages):
        page, kept = practice(k)
        own = blocks_of(page)
        if own:
            blocks.append(own)
            labels.append([int(b[0] in kept) for b in own])
    return Labeller().fit(blocks, labels)


def _extracted(model):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [blocks_of(x.as_py() or "") for x in part.column(2)]
                texts = ["\n\n".join(b[0] for b, s in zip(p, scores) if s >= 0.5) for p, scores in zip(pages, model.value.score(pages))]
                texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a lone surrogate is no character
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Labeller, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; what is broadcast is the network, of a fixed size."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").cast("string").alias("url"), F.col(f"`{html_column}`").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted(spark.sparkContext.broadcast(model)), f"page_id {kind}, url string, text string, n_chars long")


def op10_recurrent_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), learn())
