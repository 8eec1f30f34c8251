"""A plain version of the verification: all correspondences of one frame against all stars, with arrays."""

import numpy as np

MIN_MATCHED, RADII, MATCH_RADIUS, LOOSE, STILL = 6, (900.0, 400.0, 200.0, 100.0, 60.0), 60.0, 0.01, 1e-12
_ARCSEC = np.pi / 180 / 3600


def _planes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The axes of the tangent planes at many directions (n, 3)."""
    ref = np.where(np.abs(c[:, 2:]) < 0.9, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
    e1 = ref - c * (ref * c).sum(axis=1, keepdims=True)
    e1 /= np.linalg.norm(e1, axis=1, keepdims=True)
    return e1, np.cross(c, e1)


def _flat(c: np.ndarray, v: np.ndarray, mirrored: np.ndarray) -> np.ndarray:
    """Plane coordinates at the directions c (n, 3) of vectors (n, k, 3), nan on or behind the plane."""
    e1, e2 = _planes(c)
    on = lambda axis: np.einsum("nkj,nj->nk", v, axis)
    cos, turn = on(c), np.where(mirrored, -1.0, 1.0)[:, None]
    cos = np.where(cos > 1e-9, cos, np.nan)
    return np.stack([on(e1) / cos, turn * on(e2) / cos], axis=2)


def _assign(at: np.ndarray, sky: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places (n, m, 2) and stars (n, k, 2): which places have a match, their nearest stars and squared distances. Of the places that choose one star the nearest counts, the first of equally near ones."""
    real = ~np.isnan(sky[:, :, 0])
    sky = np.where(real[:, :, None], sky, 0.0)
    # the nearest star does not depend on the place's own length, which is left out of the squared distance
    star = (np.where(real, (sky * sky).sum(axis=2), np.inf)[:, None, :] - 2 * at @ np.swapaxes(sky, 1, 2)).argmin(axis=2)
    least = ((at - np.take_along_axis(sky, star[:, :, None], axis=1)) ** 2).sum(axis=2)
    least = np.where(np.take_along_axis(real, star, axis=1), least, np.inf)
    n, m = star.shape
    row, place = np.divmod(np.arange(n * m), m)
    order = np.lexsort((place, least.ravel(), star.ravel(), row))
    first = np.ones(n * m, dtype=bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (star.ravel()[order][1:] != star.ravel()[order][:-1])
    won = np.zeros(n * m, dtype=bool)
    won[order] = first
    return won.reshape(n, m) & (least < radius * radius), star, least


def first_fit(image: np.ndarray, vectors: np.ndarray, mirrored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of correspondences (n, 4, 2) with (n, 4, 3): which have a first fit without residuals over LOOSE, the fits (n, 3, 2) and the mean directions."""
    mid = vectors.sum(axis=1)
    mid /= np.linalg.norm(mid, axis=1, keepdims=True)
    flat = _flat(mid, vectors, mirrored)
    good = ~np.isnan(flat).any(axis=(1, 2))
    rows = np.concatenate([image, np.ones((*image.shape[:2], 1))], axis=2)
    square = np.swapaxes(rows, 1, 2) @ rows
    good &= np.abs(np.linalg.det(square)) >= 1e-18
    square[~good] = np.eye(3)
    fit = np.linalg.solve(square, np.swapaxes(rows, 1, 2) @ np.nan_to_num(flat))
    return good & (np.hypot(*np.moveaxis(rows @ fit - np.nan_to_num(flat), 2, 0)).max(axis=1) <= LOOSE), fit, mid


def verify_many(image: np.ndarray, vectors: np.ndarray, mirrored: np.ndarray, xy: np.ndarray, stars: np.ndarray) -> list[dict | None]:
    """Correspondences (n, 4, 2) with (n, 4, 3) of one frame with sources xy: fitted, then matched with all stars in narrowing radii, all at once. None for those that fail."""
    out: list[dict | None] = [None] * len(image)
    good, fit, mid = first_fit(image, vectors, mirrored)
    centre_px = xy.mean(axis=0)
    xi_eta = np.concatenate([centre_px, [1.0]]) @ fit
    e1, e2 = _planes(mid)
    centre = mid + e1 * xi_eta[:, :1] + e2 * np.where(mirrored, -1.0, 1.0)[:, None] * xi_eta[:, 1:]
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    flat = _flat(centre, vectors, mirrored)
    at = np.flatnonzero(good & ~np.isnan(flat).any(axis=(1, 2)))
    if not len(at):
        return out
    image, mirrored, centre, flat = image[at], mirrored[at], centre[at], flat[at]
    four = np.concatenate([image, np.ones((*image.shape[:2], 1))], axis=2)
    w = np.concatenate([np.linalg.solve(np.swapaxes(four, 1, 2) @ four, np.swapaxes(four, 1, 2) @ flat), np.zeros((len(at), 1, 2))], axis=1)
    rows = np.stack([xy[:, 0], xy[:, 1], np.ones(len(xy)), ((xy - centre_px) ** 2).sum(axis=1)], axis=1)
    row, star = np.nonzero(centre @ stars.T > 1e-9)  # all stars in front of the plane
    held = np.bincount(row, minlength=len(at))
    if held.max() == 0:
        return out
    picked = np.zeros((len(at), held.max()), dtype=np.int64)  # the stars in reach, in the order of their numbers
    real = np.arange(held.max()) < held[:, None]
    picked[real] = star
    sky = _flat(centre, stars[picked], mirrored)
    sky[~real] = np.nan
    going = held > 0
    for r in RADII:
        here = np.flatnonzero(going)
        if not len(here):
            break
        match, star, _ = _assign(rows @ w[here], sky[here], r * _ARCSEC)
        enough = match.sum(axis=1) >= 4
        going[here[~enough]] = False
        here, match, star = here[enough], match[enough], star[enough]
        if not len(here):
            break
        m = np.where(match[:, :, None], rows, 0.0)
        scale = np.abs(m).max(axis=1)
        scale[scale == 0] = 1.0
        m = m / scale[:, None, :]
        square = np.swapaxes(m, 1, 2) @ m
        value = np.linalg.eigvalsh(square)
        full = value[:, 0] > 1e-14 * value[:, -1]
        going[here[~full]] = False
        here, match, star, m, scale, square = here[full], match[full], star[full], m[full], scale[full], square[full]
        want = np.where(match[:, :, None], np.take_along_axis(sky[here], star[:, :, None], axis=1), 0.0)
        new = np.linalg.solve(square, np.swapaxes(m, 1, 2) @ want) / scale[:, :, None]
        still = np.hypot(new[:, 0, 0] - w[here, 0, 0], new[:, 1, 1] - w[here, 1, 1]) < STILL
        w[here[~still]] = new[~still]
        going[here[still]] = False
    match, star, d2 = _assign(rows @ w, sky, MATCH_RADIUS * _ARCSEC)
    for i in np.flatnonzero((match.sum(axis=1) >= MIN_MATCHED) & (held > 0)):
        (a, e), (b, f), (c, g), (d, h) = w[i]
        src = np.flatnonzero(match[i])
        out[at[i]] = {"matched": len(src), "rms_arcsec": float(np.degrees(np.sqrt(d2[i, src].mean())) * 3600), "cx": centre_px[0], "cy": centre_px[1], "a": a, "b": b, "c": c, "d": d, "e": e, "f": f, "g": g, "h": h, "x": centre[i, 0], "y": centre[i, 1], "z": centre[i, 2], "src": src, "star": picked[i, star[i, src]], "d2": d2[i, src]}
    return out
