"""URLs filtered by logistic regression on hashed character n-grams of host and path.

Host and path give separate features: all n-grams of ``SIZES`` bytes of each,
framed by end marks, hashed into ``BUCKETS``; a URL's vector has the same weight
at each of its n-grams and unit length.  The model is trained on a small table
of labelled URLs (the built-in one, or one passed in, of up to ``MOST_LABELLED``
rows) by full-batch gradient steps with a quadratic penalty, and goes to every
task as a vector of weights.

Defined results: a null or blank URL has a null score and isn't blocked;
a URL without a scheme is read from its host on; query and fragment are ignored;
repeated rows score alike.  Extra columns are ignored by :func:`score_urls`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import mapped
from ._text import buffers, mix

SIZES = (3, 4, 5)
BUCKETS = 1 << 18
BLOCK_AT = 0.5
PENALTY = 1e-4
STEPS = 2000
MOST_LABELLED = 100_000
_SPLIT = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#\s]*@)?([^/:?#\s]*)(?::\d*)?([^?#]*)")

_BAD_HOSTS = "spam-farm casino-win free-bets ads-track adserver click-bait cheap-pills buy-viagra poker-online popunder adult-cams xxx-tube hot-singles lottery-prize payday-loans win-big-now banner-ads trackpixel doubleads betting-tips slots-jackpot warez-zone crack-serial keygen-now pharma-deal replica-watches seo-links link-farm get-rich porn-hd cams-live ad-clicks track-user bets-online casino-royal free-spins spam-links malware-drop phish-login".split()
_GOOD_HOSTS = (
    "library museum university research city-news daily-herald weather gardens history-blog recipes open-science mathematics travel-notes bookclub chess-club community-forum health-guide public-records archive journal "
    "music-school astronomy poetry classroom engineering cooking parks transit biology-notes linguistics photography woodworking theatre school council orchard river-trust film-review language-lab the-times another-view "
    "northern-post southern-star western-union eastern-shore thinking-aloud interior winter-sports hotel-guide station-house nation-watch edition-press tradition motion-lab ocean-trust heathland thistle-farm thornton "
    "whitestone breadmaker leather-works weatherby theory-group anthology earth-watch method-notes either-or gathering rethinking threads shelter harbour ransom-house handbook sandstone android-notes orbit-lab reading-room "
    "heritage inland-rail ontology entire-works bleak-house table-talk stable-yard notable-lives tiger-trust hearth-and-home onward erasmus restore lantern western eddington ingleside edwardian winding-road wooden-boat "
    "learned-society shoreline washing-day wharf-side heron-lake honest-broker ounce-of-salt southwark mountain-club country-house counting-house alliance inventory antique-maps rental-advice silver-street stream-bank "
    "zeitung-archiv wetter-heute buecherei rathaus verein-nord schule-sued kirche garten-bau forschung universitaet bibliotheque mairie ecole-du-nord cuisine-maison jardin musee-local voyage cinema-du-port "
    "biblioteca escuela museo-central cocina-facil noticias jardines viajes ayuntamiento universidad deportes-sur"
).split()
_BAD_PATHS = "/win/bonus /free/spins /click?id= /track/pixel /ads/banner /buy/cheap /bet/now /casino/slots /xxx/video /promo/deal".split()
_GOOD_PATHS = "/about /articles/12 /2021/05/notes /en/345 /de/78.html /blog/post /research/papers /index.html /fr/912 /guide/chapter".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The built-in table: (url, 1 = to be blocked)."""
    out = []
    for label, hosts, paths, other in ((1, _BAD_HOSTS, _BAD_PATHS, _GOOD_PATHS), (0, _GOOD_HOSTS, _GOOD_PATHS, _GOOD_PATHS)):
        for i, host in enumerate(hosts):
            for j, prefix in enumerate(("", "www.", "m.", "blog.")):
                end = ("example.com", "example.org", "example.net")[(i + j) % 3]
                path = (paths, other)[j % 2][(i + j) % 10]
                out.append((f"http{'s' * (i % 2)}://{prefix}{host}.{end}{path}", label))
    return out


def split_url(url: str) -> tuple[str, str]:
    """(host, path) in lower case."""
    host, path = _SPLIT.match(url).groups()
    return host.lower(), path.strip().lower()


def features(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the framed texts."""
    raw, offs = buffers(pa.array([f"^{t}$" for t in texts], pa.string()))
    ends = np.repeat(offs[1:], np.diff(offs))
    row = np.repeat(np.arange(len(texts)), np.diff(offs))
    rows, buckets = [], []
    wide = np.concatenate((raw.astype(np.uint64), np.zeros(max(SIZES), np.uint64)))
    for n in SIZES:
        acc = np.full(len(raw), n * 1_000_003 + salt, np.uint64)
        for j in range(n):
            acc = acc * np.uint64(0x100000001B3) ^ wide[j : j + len(raw)]
        keep = np.arange(len(raw)) + n <= ends
        rows.append(row[keep])
        buckets.append((mix(acc[keep]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _vectors(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [split_url(u) for u in urls]
    (r1, b1), (r2, b2) = features([p[0] for p in parts], 1), features([p[1] for p in parts], 2)
    row, bucket = np.concatenate((r1, r2)), np.concatenate((b1, b2))
    return row, bucket, 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=len(urls)), 1))


def train(labelled: list[tuple[str, int]] | None = None) -> np.ndarray:
    """Weights of the buckets, the intercept last."""
    rows = [(u, y) for u, y in (labelled_urls() if labelled is None else labelled) if u and y is not None]
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    y = np.array([r[1] for r in rows], float)
    row, bucket, scale = _vectors([r[0] for r in rows])
    used, at = np.unique(bucket, return_inverse=True)
    w, b, rate = np.zeros(len(used)), 0.0, 8.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[at], len(rows)) * scale + b)))
        gap = (p - y) / len(rows)
        w -= rate * (np.bincount(at, (gap * scale)[row], len(used)) + PENALTY * w)
        b -= rate * gap.sum()
    weights[used], weights[-1] = w, b
    return weights


def scores(urls: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Probability that each URL is to be blocked; NaN where there is none."""
    known = [i for i, u in enumerate(urls) if u and u.strip()]
    out = np.full(len(urls), np.nan)
    if known:
        row, bucket, scale = _vectors([urls[i] for i in known])
        out[known] = 1 / (1 + np.exp(-(np.bincount(row, weights[bucket], len(known)) * scale + weights[-1])))
    return out


def score_urls(pages: DataFrame, weights: np.ndarray, id_column: str = "page_id", block_at: float = BLOCK_AT) -> DataFrame:
    """(id_column, url, score, blocked) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = scores(b.column("url").to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([b.column(id_column), b.column("url"), pa.array(p, mask=np.isnan(p)), pa.array(p >= block_at)], names=[id_column, "url", "score", "blocked"])

    return mapped(pages.select(id_column, "url"), run, f"{id_column} {dict(pages.dtypes)[id_column]}, url string, score double, blocked boolean")
