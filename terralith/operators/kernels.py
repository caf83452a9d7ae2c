"""Segmentation of one tile as numpy arrays: what pixels, rows and joins can't say well.

Every kernel takes an image (bands, rows, columns) of floats and gives labels (rows, columns) from 1 on, without
gaps. They are run for a tile at a time inside grouped pandas functions.
"""

from __future__ import annotations

import heapq
import math
from array import array

import numpy as np

Array = np.ndarray


def smoothed(image: Array, sigma: float) -> Array:
    """Each band under a Gaussian of sigma pixels, edges mirrored."""
    if sigma <= 0:
        return image.astype(float, copy=False)
    reach = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = image.astype(float)
    for axis in (1, 2):
        n = out.shape[axis]
        at = np.arange(-reach, n + reach) % (2 * n)
        padded = np.take(out, np.where(at < n, at, 2 * n - 1 - at), axis=axis)
        out = sum(w * np.take(padded, np.arange(k, k + n), axis=axis) for k, w in enumerate(kernel))
    return out


class Sets:
    """Union-find over whole numbers; the least member stands for its set."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> int:
        a, b = self.root(a), self.root(b)
        low, high = min(a, b), max(a, b)
        self.parent[high] = low
        return low

    def roots(self) -> Array:
        p = np.array(self.parent)
        while True:
            q = p[p]
            if (q == p).all():
                return p
            p = q


def numbered(labels: Array, nodata: int | None = None) -> Array:
    """labels as 1 to K in ascending order; those of nodata as 0."""
    values, inverse = np.unique(labels, return_inverse=True)
    new = np.arange(1, len(values) + 1)
    if nodata is not None and nodata in values:
        new = np.where(values == nodata, 0, np.cumsum(values != nodata))
    return new[inverse].reshape(labels.shape).astype(np.int32)


def least_linked(n: int, a: Array, b: Array) -> Array:
    """The least of the whole numbers below n that each is linked with over the pairs (a, b), itself included."""
    least = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
    while len(a):
        # the roots of each pair: the larger one goes to the smallest that it meets
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(least, high, low)
        while True:
            further = least[least]
            if (further == least).all():
                break
            least = further
    return least


def clumps(classes: Array) -> Array:
    """Connected pieces, over sides, of pixels of one class, from 1 on."""
    h, w = classes.shape
    at = np.arange(h * w, dtype=np.int32 if h * w < 2**31 else np.int64).reshape(h, w)
    across, down = classes[:, :-1] == classes[:, 1:], classes[:-1] == classes[1:]
    a, b = np.concatenate([at[:, :-1][across], at[:-1][down]]), np.concatenate([at[:, 1:][across], at[1:][down]])
    least = least_linked(h * w, a, b)
    return np.cumsum(least == at.ravel(), dtype=np.int32)[least].reshape(h, w)


def touching(labels: Array) -> Array:
    """Pairs of different labels side by side, each once, the smaller one first."""
    most = int(labels.max()) + 1
    found = []
    for a, b in ((labels[:, :-1], labels[:, 1:]), (labels[:-1], labels[1:])):
        apart = a != b
        a, b = a[apart], b[apart]
        found.append(np.unique(np.minimum(a, b).astype(np.int64) * most + np.maximum(a, b)))
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs // most, pairs % most], 1).astype(labels.dtype)


def plain(values: Array, kind: str) -> array:
    """values as an array of Python numbers, quick to get one at a time."""
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, out.typecode).view(np.uint8).data)
    return out


def absorbed(image: Array, labels: Array, least: int, most_distance: float | None = None) -> Array:
    """Segments of fewer than least pixels, the smallest first, go to the neighbour with the nearest mean, if that
    isn't further than most_distance."""
    n, bands = int(labels.max()) + 1, len(image)
    # plain numbers: most segments have a handful of neighbours, too few for arrays to pay, and sets of them would take
    # far more memory than the image
    count = np.bincount(labels.ravel(), minlength=n)
    size = plain(count, "d")
    total = plain(np.stack([np.bincount(labels.ravel(), band.ravel().astype(float, copy=False), n) for band in image], 1).ravel(), "d")
    pairs = touching(labels)
    ends = np.concatenate([pairs[:, 0], pairs[:, 1]])
    order = np.argsort(ends, kind="stable")
    first = plain(np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]), "q")
    near = plain(np.concatenate([pairs[:, 1], pairs[:, 0]])[order], "i")
    del pairs, ends, order
    # the segments that went to one, as a chain that begins with it
    to, after, last = plain(np.arange(n), "i"), plain(np.zeros(n), "i"), plain(np.arange(n), "i")
    small = np.flatnonzero((count > 0) & (count < least))
    small = small[small > 0]
    waiting = plain(np.sort(count[small] << 32 | small), "q")
    del small
    at, queue = 0, []
    while queue or at < len(waiting):
        if queue and (at == len(waiting) or queue[0] < waiting[at]):
            code = heapq.heappop(queue)
        else:
            code = waiting[at]
            at += 1
        s, k = float(code >> 32), code & 0xFFFFFFFF
        if to[k] != k or s != size[k]:
            continue
        met, m = set(), k
        while m:
            for x in near[first[m] : first[m + 1]]:
                while to[x] != x:
                    to[x] = to[to[x]]
                    x = to[x]
                met.add(x)
            m = after[m]
        others = sorted(met - {0, k})
        if not others:
            continue
        mean = [t / s for t in total[k * bands : (k + 1) * bands]]
        distance = [math.sqrt(sum((t / size[x] - m) ** 2 for t, m in zip(total[x * bands : (x + 1) * bands], mean, strict=True))) for x in others]
        nearest = min(distance)
        if most_distance is not None and nearest > most_distance:
            continue
        x = others[distance.index(nearest)]
        to[k] = x
        size[x] += s
        for i in range(bands):
            total[x * bands + i] += total[k * bands + i]
        after[last[x]] = k
        last[x] = last[k]
        if size[x] < least:
            heapq.heappush(queue, int(size[x]) << 32 | x)
    roots = np.array(to)
    while (roots[roots] != roots).any():
        roots = roots[roots]
    there = np.zeros(n, bool)
    there[roots[count > 0]] = True
    there[0] = False
    return np.where(there, np.cumsum(there), 0).astype(np.int32)[roots][labels]


def slic(image: Array, n_segments: int = 500, compactness: float = 10.0, sigma: float = 0.0, min_size_factor: float = 0.5, enforce_connectivity: bool = True, iterations: int = 10) -> Array:
    """Local k-means in place and colour: seeds on a grid of step S look at pixels up to 2 S away, at a distance of
    colour^2 + (compactness / S * place)^2. Bands are scaled so that the image spans 0 to 100."""
    image = smoothed(image, sigma)
    bands, h, w = image.shape
    low, high = image.min(), image.max()
    scaled = image - low
    scaled *= 100.0 / (high - low) if high > low else 0.0
    del image
    colour = np.moveaxis(scaled, 0, 2)
    step = max(1.0, np.sqrt(h * w / max(1, n_segments)))
    rows = np.arange(step / 2, h, step)
    cols = np.arange(step / 2, w, step)
    centres = np.array([(r, c, *colour[min(h - 1, int(r)), min(w - 1, int(c))]) for r in rows for c in cols])
    yy, xx = np.arange(h, dtype=float)[:, None], np.arange(w, dtype=float)[None]
    weight = (compactness / step) ** 2
    labels = np.zeros((h, w), np.int32)
    for _ in range(iterations):
        best = np.full((h, w), np.inf)
        for k, centre in enumerate(centres):
            r0, r1 = max(0, int(centre[0] - 2 * step)), min(h, int(centre[0] + 2 * step) + 1)
            c0, c1 = max(0, int(centre[1] - 2 * step)), min(w, int(centre[1] + 2 * step) + 1)
            d = ((colour[r0:r1, c0:c1] - centre[2:]) ** 2).sum(2) + weight * ((yy[r0:r1] - centre[0]) ** 2 + (xx[:, c0:c1] - centre[1]) ** 2)
            closer = d < best[r0:r1, c0:c1]
            best[r0:r1, c0:c1][closer] = d[closer]
            labels[r0:r1, c0:c1][closer] = k
        del best
        flat = labels.ravel()
        count = np.bincount(flat, minlength=len(centres))
        sums = np.stack([np.bincount(flat, v, len(centres)) for v in (np.broadcast_to(yy, (h, w)).ravel(), np.broadcast_to(xx, (h, w)).ravel(), *scaled.reshape(bands, -1))], 1)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    if not enforce_connectivity:
        return numbered(labels)
    return absorbed(scaled, clumps(labels), max(1, int(min_size_factor * step * step)))


def felzenszwalb(image: Array, scale: float = 100.0, sigma: float = 0.8, min_size: int = 50) -> Array:
    """Graph of pixels and their eight neighbours: edges in order of colour distance join two parts if the edge is no
    longer than either part's longest one plus scale over its size; then parts below min_size are joined along the
    shortest edges. Bands are scaled so that the image spans 0 to 1."""
    image = image.astype(float)
    low, high = image.min(), image.max()
    image = smoothed((image - low) / (high - low) if high > low else image * 0, sigma)
    scale = scale / 255.0
    _, h, w = image.shape
    at = np.arange(h * w).reshape(h, w)
    cuts = [((slice(None), slice(None, -1)), (slice(None), slice(1, None))), ((slice(None, -1), slice(None)), (slice(1, None), slice(None))), ((slice(None, -1), slice(None, -1)), (slice(1, None), slice(1, None))), ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))]
    a = np.concatenate([at[p].ravel() for p, _ in cuts])
    b = np.concatenate([at[q].ravel() for _, q in cuts])
    cost = np.concatenate([np.sqrt(((image[(slice(None), *p)] - image[(slice(None), *q)]) ** 2).sum(0)).ravel() for p, q in cuts])
    order = np.argsort(cost, kind="stable")
    sets, size, bound = Sets(h * w), [1] * (h * w), [scale] * (h * w)
    edges = list(zip(a[order].tolist(), b[order].tolist(), cost[order].tolist(), strict=True))
    for x, y, c in edges:
        x, y = sets.root(x), sets.root(y)
        if x != y and c <= min(bound[x], bound[y]):
            n = size[x] + size[y]
            r = sets.join(x, y)
            size[r], bound[r] = n, c + scale / n
    for x, y, _ in edges:
        x, y = sets.root(x), sets.root(y)
        if x != y and min(size[x], size[y]) < min_size:
            n = size[x] + size[y]
            size[sets.join(x, y)] = n
    return numbered(sets.roots().reshape(h, w))


def sobel(band: Array) -> Array:
    """Size of the gradient, edges repeated."""
    p = np.pad(band.astype(float), 1, mode="edge")
    smooth = lambda x, axis: sum(w * np.take(x, np.arange(k, k + x.shape[axis] - 2), axis=axis) for k, w in enumerate((0.25, 0.5, 0.25)))
    slope = lambda x, axis: np.take(x, np.arange(2, x.shape[axis]), axis=axis) / 2 - np.take(x, np.arange(x.shape[axis] - 2), axis=axis) / 2
    return np.sqrt((slope(smooth(p, 1), 0) ** 2 + slope(smooth(p, 0), 1) ** 2) / 2)


def local_minima(surface: Array, min_distance: int, most: int) -> list[tuple[int, int]]:
    """The deepest places that nothing within min_distance rows and columns undercuts, at most so many, apart from
    each other by more than that."""
    h, w = surface.shape
    low = surface.copy()
    for axis in (0, 1):
        p = np.pad(low, [(min_distance, min_distance) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        low = np.min([np.take(p, np.arange(k, k + surface.shape[axis]), axis=axis) for k in range(2 * min_distance + 1)], axis=0)
    rows, cols = np.nonzero(surface == low)
    taken, out = np.zeros((h, w), bool), []
    for i in np.lexsort((cols, rows, surface[rows, cols])):
        r, c = int(rows[i]), int(cols[i])
        if not taken[r, c]:
            out.append((r, c))
            taken[max(0, r - min_distance) : r + min_distance + 1, max(0, c - min_distance) : c + min_distance + 1] = True
            if len(out) >= most:
                break
    return out


def watershed(image: Array, markers: int = 500, compactness: float = 0.0, min_distance: int = 10) -> Array:
    """Floods the mean gradient of the bands from its deepest minima. compactness adds the distance to the marker."""
    surface = np.mean([sobel(b) for b in image], axis=0)
    h, w = surface.shape
    seeds = local_minima(surface, max(1, min_distance), markers) or [(h // 2, w // 2)]
    labels = np.zeros((h, w), np.int32)
    queue: list[tuple[float, int, int, int, int]] = []
    order = 0
    for k, (r, c) in enumerate(seeds, 1):
        labels[r, c] = k
        queue.append((float(surface[r, c]), order, r, c, k))
        order += 1
    heapq.heapify(queue)
    while queue:
        _, _, r, c, k = heapq.heappop(queue)
        for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if 0 <= y < h and 0 <= x < w and not labels[y, x]:
                labels[y, x] = k
                far = compactness * float(np.hypot(y - seeds[k - 1][0], x - seeds[k - 1][1])) if compactness else 0.0
                heapq.heappush(queue, (float(surface[y, x]) + far, order, y, x, k))
                order += 1
    return labels


def shepherd(image: Array, num_clusters: int = 60, min_n_pxls: int = 100, dist_thres: float | str = "auto", sampling: int = 100, iterations: int = 200, valid: Array | None = None) -> Array:
    """k-means of the pixels' colours from fixed starts, connected pieces of its classes, then small pieces go to the
    neighbour of the nearest colour. Bands are scaled to 0 to 10000; "auto" takes the distance that the nearer half
    of the class centres have to each other twice over. The centres are found on a share of the pixels. Pixels that are
    not valid have no part in centres, pieces or neighbours, only in the scale, and get 0."""
    image = image.astype(float)
    low, high = image.min(), image.max()
    scaled = np.floor((image - low) * (10000 / (high - low))) if high > low else image * 0
    bands, h, w = scaled.shape
    pixels = scaled.reshape(bands, -1).T
    share = max(1, 100 // max(1, sampling))
    valid = np.ones((h, w), bool) if valid is None else valid
    if not valid.any():
        return np.zeros((h, w), np.int32)
    sample = pixels[valid.ravel()][::share]
    k = max(1, min(num_clusters, len(np.unique(sample, axis=0))))
    ends = np.stack([sample.min(0), sample.max(0)])
    centres = ends[0] + (ends[1] - ends[0]) * ((np.arange(k) + 0.5) / k)[:, None]

    def nearest(x: Array) -> Array:
        # band by band, centres along the rows, so that sums run over long rows
        parts = np.array_split(x.T, max(1, len(x) * k // 2_000_000), axis=1)
        return np.concatenate([sum((part[b] - centres[:, b, None]) ** 2 for b in range(bands)).argmin(0) for part in parts])

    for _ in range(iterations):
        of = nearest(sample)
        count = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, sample[:, b], k) for b in range(bands)], 1)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        if np.abs(moved - centres).max() < 1e-4:
            break
        centres = moved
    most = None
    if dist_thres == "auto":
        if k > 1:
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.where(np.eye(k) > 0, np.inf, 0)
            most = 2 * float(np.median(gaps.min(1)))
    elif dist_thres is not None:
        most = float(dist_thres)
    pieces = clumps(np.where(valid, nearest(pixels).reshape(h, w), -1))
    return absorbed(scaled, numbered(np.where(valid, pieces, 0), nodata=0), min_n_pxls, most)
