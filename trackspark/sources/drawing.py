"""Boxes, trails and labels on pictures (blue, green, red bytes of height, width, 3)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

#: Glyphs of five lines of three pixels, a line an octal digit (4: left, 2: middle, 1: right).
GLYPHS = {
    "0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717",
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152",
    "K": "55655", "L": "44447", "M": "57755", "N": "65555", "O": "25552", "P": "65644", "Q": "25563", "R": "65655", "S": "34216", "T": "72222",
    "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247", "-": "00700", ".": "00002", "/": "11244", "#": "57575",
    ":": "02020", "%": "51245", " ": "00000", "_": "00007", "|": "22222",
}
UNKNOWN = "75257"
ADVANCE, LINE = 4, 5


def text_size(text: str, scale: int = 2) -> tuple[int, int]:
    """Width and height of a text in pixels, with a margin of one glyph pixel around it."""
    return (len(text) * ADVANCE + 1) * scale, (LINE + 2) * scale


def text_mask(text: str, scale: int = 2) -> np.ndarray:
    """The pixels of a text within its size; letters are capitals, unknown signs a box."""
    bits = np.zeros((LINE + 2, len(text) * ADVANCE + 1), bool)
    for k, sign in enumerate(text.upper()):
        lines = GLYPHS.get(sign, UNKNOWN)
        bits[1 : 1 + LINE, 1 + k * ADVANCE : 4 + k * ADVANCE] = [[int(line) >> (2 - x) & 1 for x in range(3)] for line in lines]
    return bits.repeat(scale, 0).repeat(scale, 1)


def fill(image: np.ndarray, x1: int, y1: int, x2: int, y2: int, color: Sequence[int]) -> None:
    """A rectangle from (x1, y1) to before (x2, y2), as far as it lies in the picture."""
    image[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = color


def box(image: np.ndarray, x1: int, y1: int, x2: int, y2: int, color: Sequence[int], thick: int = 2) -> None:
    """The border of a rectangle, inside its corners."""
    fill(image, x1, y1, x2, min(y1 + thick, y2), color)
    fill(image, x1, max(y2 - thick, y1), x2, y2, color)
    fill(image, x1, y1, min(x1 + thick, x2), y2, color)
    fill(image, max(x2 - thick, x1), y1, x2, y2, color)


def line(image: np.ndarray, points: Iterable[tuple[int, int]], color: Sequence[int], thick: int = 2) -> None:
    """Straight lines through points, a square of thick pixels at every step."""
    points = list(points)
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        steps = max(abs(bx - ax), abs(by - ay), 1)
        for k in range(steps + 1):
            x, y = ax + (bx - ax) * k // steps, ay + (by - ay) * k // steps
            fill(image, x, y, x + thick, y + thick, color)


def label(image: np.ndarray, text: str, left: int, top: int, color: Sequence[int], scale: int = 2) -> None:
    """A text in color on black."""
    wide, high = text_size(text, scale)
    fill(image, left, top, left + wide, top + high, (0, 0, 0))
    mask = text_mask(text, scale)
    y, x = np.nonzero(mask)
    y, x = y + top, x + left
    inside = (y >= 0) & (x >= 0) & (y < image.shape[0]) & (x < image.shape[1])
    image[y[inside], x[inside]] = color
