import itertools
import json
import random

import numpy as np
import pytest

from boxloom.functions import detections, matching
from boxloom.functions.matching import THRESHOLDS, matched, overlaps, true_positives


def brute(iou, threshold):
    n, m = iou.shape
    best = (0, 0.0)
    cols = [*range(m), *[None] * n]
    for pick in set(itertools.permutations(cols, n)):
        pairs = [iou[i, j] for i, j in enumerate(pick) if j is not None and (iou[i, j] > 0 if threshold is None else iou[i, j] >= threshold)]
        score = (len(pairs), sum(pairs)) if threshold is not None else (0, sum(pairs))
        best = max(best, score)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_matching_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    iou = rng.random((int(rng.integers(1, 4)), int(rng.integers(1, 5)))) * (rng.random() < 0.8)
    iou[rng.random(iou.shape) < 0.3] = 0
    for t in (None, 0.5, 0.75):
        n, total = matched(iou, t)
        want = brute(iou, t)
        assert total == pytest.approx(want[1]) and (t is None or n == want[0])
    assert true_positives(iou) == [brute(iou, t)[0] for t in THRESHOLDS]


def grid_of_boxes(rng, n):
    """``n`` boxes in cells of their own, so that none overlaps another."""
    cells = rng.sample([(x, y) for x in range(9) for y in range(9)], n)
    return [(x * 111 + rng.randrange(10), y * 111 + rng.randrange(10), x * 111 + 50 + rng.randrange(50), y * 111 + 50 + rng.randrange(50)) for x, y in cells]


@pytest.mark.parametrize("seed", range(12))
def test_apart_boxes_match_themselves_whatever_the_order(seed):
    rng = random.Random(seed)
    truth = grid_of_boxes(rng, rng.randrange(1, 70))
    kept = rng.sample(truth, rng.randrange(1, len(truth) + 1))
    said = kept + rng.choices(kept, k=rng.randrange(4))  # repeats match nothing more
    rng.shuffle(said)
    iou = overlaps(np.array(said, float), np.array(truth, float))
    assert true_positives(iou) == [len(kept)] * len(THRESHOLDS)
    assert matched(iou, 0.5) == (len(kept), pytest.approx(len(kept)))


def items(rng):
    out = []
    for _ in range(rng.randrange(4)):
        (x1, x2), (y1, y2) = (sorted(rng.sample(range(1001), 2)) for _ in range(2))
        out.append({"bbox_2d": [x1, y1, x2, y2]} | ({"label": rng.choice(["ring", "é", None])} if rng.random() < 0.4 else {}))
    return out


def test_strict_parse_takes_what_json_dumps():
    rng = random.Random(4)
    for _ in range(200):
        made = items(rng)
        text = rng.choice(["", " ", "\n\t"]) + json.dumps(made, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\r\n "])
        boxes, labels = detections.parse(text)
        assert [list(b) for b in boxes] == [m["bbox_2d"] for m in made]
        assert detections.parse(detections.serialize(boxes, labels)) == (boxes, labels)
    assert [list(b) for b in detections.parse('[{"bbox_2d":[7,7,7,7],"bbox_2d":[7,8,17,18]}]')[0]] == [[7, 8, 17, 18]]  # the last of like keys counts


#: What may not stand in place of a coordinate, of an item, or around the list.
NO_NUMBER = [2.5, 3.0, True, False, None, "7", [7], {}, -7, 1001, 10**30]
NO_ITEM = [None, 0, "box", [], {}, {"label": "ring"}, {"bbox_2d": None}, {"bbox_2d": {}}, {"bbox_2d": [4, 5, 6]}, {"bbox_2d": [4, 5, 6, 7, 8]}, {"bbox_2d": [4, 5, 6, 7], "sure": 0.5}, {"bbox_2d": [4, 5, 6, 7], "label": 3}, {"bbox_2d": [4, 5, 6, 7], "label": ["ring"]}, {"Bbox_2d": [4, 5, 6, 7]}]


def test_strict_parse_refuses_what_is_changed():
    rng = random.Random(5)
    bad = [None, "", " ", "null", "7", "nan", "Infinity", "[" * 60_000, "[[", '[{"bbox_2d":[4,5,6,' + "8" * 6000 + "]}]"]
    for _ in range(40):
        made = items(rng) or [{"bbox_2d": [4, 5, 6, 7]}]
        text, at = json.dumps(made), rng.randrange(len(made))
        bad += [text[:-1], text[1:], text + "]", text + " ok", "> " + text, f"`{text}`", f"~~~\n{text}\n~~~", json.dumps({"items": made}), text.replace('"', "'"), text[:-1] + ",]"]
        box, corner = made[at]["bbox_2d"], rng.randrange(4)
        for wrong in NO_NUMBER:
            bad.append(json.dumps([*made[:at], made[at] | {"bbox_2d": [*box[:corner], wrong, *box[corner + 1 :]]}, *made[at + 1 :]]))
        bad.append(json.dumps([*made, {"bbox_2d": [box[2], box[1], box[0], box[3]]}]))
        bad += [json.dumps([*made[:at], wrong, *made[at:]]) for wrong in NO_ITEM]
    for text in bad:
        with pytest.raises(ValueError):
            detections.parse(text)


def test_largest_by_random_graphs():
    from boxloom.functions.matching import largest

    rng = random.Random(1)
    for _ in range(60):
        edges = [[j for j in range(4) if rng.random() < 0.4] for _ in range(4)]
        best = max(sum(j in edges[i] for i, j in enumerate(p)) for p in itertools.permutations(range(4)))
        assert largest(edges) == best


@pytest.mark.parametrize("seed", range(6))
def test_many_sets_as_one_by_one(seed):
    rng = random.Random(seed)

    def boxes(n):
        corners = ((rng.randrange(0, 40, 4), rng.randrange(0, 40, 4)) for _ in range(n))
        return [[x, y, x + rng.randrange(8, 40, 4), y + rng.randrange(8, 40, 4)] for x, y in corners]

    sets = [(boxes(rng.randrange(0, 9)), boxes(rng.randrange(0, 9))) for _ in range(150)] + [(boxes(33), boxes(17)), ([], []), (boxes(2), [])]
    flat = []
    for side in (0, 1):
        flat += [np.array([b for s in sets for b in s[side]], float).reshape(-1, 4), np.r_[0, np.cumsum([len(s[side]) for s in sets])]]
    counts, totals = matching.match_many(*flat)
    for (a, b), tp, total in zip(sets, counts, totals, strict=True):
        iou = matching.overlaps(np.array(a, float), np.array(b, float))
        assert tp.tolist() == (matching.true_positives(iou) if iou.size else [0] * 10)
        assert total == pytest.approx(matching.matched(iou)[1])
    assert matching.match_many(*flat, totals=False)[0].tolist() == counts.tolist()


def test_many_assignments():
    rng = np.random.default_rng(4)
    gain = np.where(rng.random((200, 5, 7)) < 0.5, rng.random((200, 5, 7)), 0)
    for one, cols in zip(gain, matching.assign_many(gain), strict=True):
        assert len(set(cols)) == 5 and sum(one[i, c] for i, c in enumerate(cols)) == pytest.approx(sum(one[i, j] for i, j in matching.assign(one)))
