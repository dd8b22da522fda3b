"""HTML main-text extraction by a recurrent block labeller.

A page is the sequence of its leaf blocks. Each block is a vector of its tag path (the hashed
tags and class words of its ancestors), its hashed words and a few measures; a bidirectional
LSTM in numpy reads the sequence both ways, so every block is labelled in the light of the
whole page. The labeller is trained here on pages from ``page_maker``, whose labels are
known; ``TRAIN_PAGES`` bounds that sample. The driver trains once in a session (a few
seconds) and broadcasts about a megabyte of weights.

Edge cases. A null, empty or tagless page is handled like any other: no block, or one. Blocks
are kept or left out whole. Character references are decoded, white space in a block becomes
one space, blocks are joined by two newlines; nothing is cut short. Repeated rows and null ids
are allowed; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverwell.llm.common import ship_package
from coverwell.llm.html_blocks import Block, blocks
from coverwell.llm.page_maker import PageMaker

TRAIN_PAGES, EPOCHS, BATCH, SEED = 1000, 6, 20, 7
PATHS, WORDS, E, H, MEASURES = 8192, 2048, 24, 16, 7
MARK = re.compile(r" q(\d+)q$")
Params = dict[str, np.ndarray]


class Hashed(dict):
    """Bucket of a token, by CRC-32."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[token] = b = zlib.crc32(token.encode("utf-8", "surrogatepass")) % self.buckets
        return b


_path_bucket, _word_bucket = Hashed(PATHS), Hashed(WORDS)


def path_tokens(path: str) -> list[int]:
    """Buckets of the path's elements; the last element also counts by itself."""
    elements = path.split("/")[1:]
    tokens = {t for e in elements for t in e.split(".")}
    tokens |= {"^" + t[:4] for e in elements for t in e.split(".")[1:]}  # so that unseen class words resemble known ones
    return sorted({_path_bucket[t] for t in tokens} | {_path_bucket["@" + elements[-1].split(".")[0]]} if elements else set())


def measures(page: list[Block]) -> np.ndarray:
    n = len(page)
    out = np.zeros((n, MEASURES), np.float32)
    for i, b in enumerate(page):
        size = len(b.text)
        out[i] = (
            np.log1p(size) / 6, b.links, b.text[-1] in ".!?…。", i / n, (n - 1 - i) / n, np.log1p(b.text.count(" ")) / 4, b.path.count("/") / 10
        )
    return out


def fresh(seed: int) -> Params:
    r = np.random.default_rng(seed)
    normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"Ep": np.zeros((PATHS, E)), "Ew": np.zeros((WORDS, E)), "Wn": normal(MEASURES, E), "b0": np.zeros(E), "Wo": normal(2 * H + E, 1)[:, 0], "bo": np.zeros(1)}
    for d in "fb":
        p |= {f"W{d}": normal(E, 4 * H), f"U{d}": normal(H, 4 * H), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], H)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Steps whose inputs are multiplied at once.
STEPS = 4096


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, c0: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, H) of inputs (time, batch, E), and with ``keep`` what the way back needs, which grows with time."""
    h = np.zeros((x.shape[1], H), np.float32)
    c = np.zeros_like(h)
    out, saved = np.empty((len(x), x.shape[1], H), np.float32), []
    for t in range(len(x)):
        if t % STEPS == 0:
            z_in = x[t : t + STEPS] @ w + c0
        z = z_in[t % STEPS] + h @ u
        gates = sigmoid(z[:, : 3 * H])
        i, f, o, g = gates[:, :H], gates[:, H : 2 * H], gates[:, 2 * H :], np.tanh(z[:, 3 * H :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            saved.append((i, f, o, g, before, tc, h))
        h = o * tc
        out[t] = h
    return out, saved


def lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, saved: list, dout: np.ndarray):
    """Gradients of the inputs and weights, given those of the hidden states."""
    dz = np.empty((len(x), x.shape[1], 4 * H), np.float32)
    dh = np.zeros((x.shape[1], H), np.float32)
    dc = np.zeros_like(dh)
    du = np.zeros_like(u)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, tc, h = saved[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        du += h.T @ dz[t]
        dh = dz[t] @ u.T
        dc = dc * f
    flat = dz.reshape(-1, 4 * H)
    return dz @ w.T, x.reshape(-1, E).T @ flat, du, flat.sum(axis=0)


def flipped(lengths: np.ndarray, longest: int) -> np.ndarray:
    """For each page, its places in reverse; padding stays where it is."""
    t = np.arange(longest)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def forward(p: Params, pre: np.ndarray, lengths: np.ndarray, keep: bool = True):
    """Logits (time, batch) of summed inputs ``pre`` (time, batch, E), and with ``keep`` what training needs."""
    x = np.tanh(pre)
    turn, column = flipped(lengths, len(x)), np.arange(len(lengths))
    hf, sf = lstm(x, p["Wf"], p["Uf"], p["cf"], keep)
    hb, sb = lstm(x[turn, column], p["Wb"], p["Ub"], p["cb"], keep)
    states = np.concatenate([hf, hb[turn, column], x], axis=2)
    return states @ p["Wo"] + p["bo"], (x, turn, column, sf, sb, states)


def word_buckets(text: str) -> list[int]:
    return [_word_bucket[w] for w in set(text.lower().split())]


def word_share(n: int) -> float:
    """The weight of each of ``n`` words: a mean, in which fewer than eight words count for less."""
    return 1 / max(n, 8)


def inputs(p: Params, features: tuple, with_words: bool = True) -> np.ndarray:
    tokens, words, m = features
    pre = m @ p["Wn"] + p["b0"]
    for i, t in enumerate(tokens):
        pre[i] += p["Ep"][t].sum(axis=0)
    if with_words:
        for i, w in enumerate(words):
            pre[i] += p["Ew"][w].sum(axis=0) * word_share(len(w))
    return pre


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in pages])
    out = np.zeros((lengths.max(), len(pages), pages[0].shape[-1]), np.float32)
    for j, x in enumerate(pages):
        out[: len(x), j] = x
    return out, lengths


@functools.cache
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Params:
    """The labeller's weights, the same for the same arguments."""
    maker, r = PageMaker(seed), np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        html, labels = maker.page()
        page, y = [], []
        for b in blocks(html):
            if m := MARK.search(b.text):
                page.append(b._replace(text=b.text[: m.start()] or "."))
                y.append(labels[int(m[1])])
        if page:
            features = ([path_tokens(b.path) for b in page], [word_buckets(b.text) for b in page], measures(page))
            data.append((features, np.array(y, np.float32)))
    p = fresh(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), BATCH):
            chosen = [data[j] for j in order[at : at + BATCH]]
            spoken = r.random(len(chosen)) < 0.7  # the others are read by their paths alone
            pre, lengths = padded([inputs(p, f, w) for (f, _), w in zip(chosen, spoken, strict=True)])
            y, _ = padded([yy[:, None] for _, yy in chosen])
            mask = np.arange(len(pre))[:, None] < lengths
            logits, (x, turn, column, sf, sb, states) = forward(p, pre, lengths)
            dl = (sigmoid(logits) - y[:, :, 0]) * mask / mask.sum()
            grad = {"Wo": np.einsum("tb,tbk->k", dl, states), "bo": dl.sum(keepdims=True).reshape(1)}
            ds = dl[:, :, None] * p["Wo"]
            dxf, grad["Wf"], grad["Uf"], grad["cf"] = lstm_back(x, p["Wf"], p["Uf"], sf, ds[:, :, :H])
            dxb, grad["Wb"], grad["Ub"], grad["cb"] = lstm_back(x[turn, column], p["Wb"], p["Ub"], sb, ds[:, :, H : 2 * H][turn, column])
            dpre = (dxf + dxb[turn, column] + ds[:, :, 2 * H :]) * (1 - x * x) * mask[:, :, None]
            grad |= {"Wn": np.zeros_like(p["Wn"]), "Ep": np.zeros_like(p["Ep"]), "Ew": np.zeros_like(p["Ew"]), "b0": dpre.sum(axis=(0, 1))}
            for j, ((tokens, words, m), _) in enumerate(chosen):
                grad["Wn"] += m.T @ dpre[: len(m), j]
                for i, t in enumerate(tokens):
                    grad["Ep"][t] += dpre[i, j]
                for i, w in enumerate(words if spoken[j] else ()):
                    np.add.at(grad["Ew"], w, dpre[i, j] * word_share(len(w)))  # words of one bucket all count
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


class Labeller:
    """Labels pages with fixed weights; the sum over a tag path is kept by path."""

    def __init__(self, p: Params):
        self.p, self.paths = p, {}

    def pre(self, page: list[Block]) -> np.ndarray:
        p = self.p
        out = measures(page) @ p["Wn"] + p["b0"]
        words, paths = [word_buckets(b.text) for b in page], []
        for b in page:
            known = self.paths.get(b.path)
            if known is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                known = self.paths[b.path] = p["Ep"][path_tokens(b.path)].sum(axis=0)
            paths.append(known)
        sizes = np.array([len(w) for w in words])  # a block has a word at least
        ends = np.cumsum(sizes)
        sums = np.add.reduceat(p["Ew"][np.concatenate(words)], ends - sizes)
        return out + np.array(paths) + sums / np.maximum(sizes, 8)[:, None]

    def keep(self, pages: list[list[Block]], cells: int = 16_384) -> list[np.ndarray]:
        """For each page, which blocks belong to the article. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((j for j in range(len(pages)) if pages[j]), key=lambda j: len(pages[j]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= cells:
                end += 1
            pre, lengths = padded([self.pre(pages[j]) for j in order[at:end]])
            logits, _ = forward(self.p, pre, lengths, keep=False)
            for k, j in enumerate(order[at:end]):
                out[j] = logits[: lengths[k], k] > 0
            at = end
        return out

    def texts(self, htmls: list[str | None]) -> list[str]:
        pages = [blocks(h) for h in htmls]
        return ["\n\n".join(b.text for b, k in zip(page, keep, strict=True) if k) for page, keep in zip(pages, self.keep(pages), strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row's whole ``html``."""
    ship_package(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeller = Labeller(weights.value)
        for html in batches:
            htmls = list(html)
            yield pd.Series([t for at in range(0, len(htmls), 256) for t in labeller.texts(htmls[at : at + 256])], dtype=object)

    return pages.select("page_id", "url", main_text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
