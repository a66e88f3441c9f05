"""Portfolios, reporting units and reference frames."""

from __future__ import annotations

# Weight of the numeraire and of the four series in each book.
BOOKS = {
    "funded_assets": (-1.0, (0.25, 0.25, 0.25, 0.25)),
    "net_cashflows": (0.0, (0.4, 0.1, -0.3, -0.2)),
    "financed_treasury": (-0.6, (0.5, 0.3, -0.15, -0.05)),
    "unfinanced_treasury": (0.0, (0.5, 0.3, -0.15, -0.05)),
}

#: Reporting units: the numeraire and the first series.
REPORTS = {"base": 0, "s1": 1}

#: Reference frames: the numeraire and each series; NODES are what a frame measures.
REFERENCES = ("base", "s1", "s2", "s3", "s4")


def basis(reference: str) -> list[tuple[str, list[int]]]:
    """(node, coefficients on the four series' log increments) of a reference frame: +1 at the node, -1 at the reference; the numeraire has no column."""
    at = REFERENCES.index(reference)
    out = []
    for i, node in enumerate(REFERENCES):
        if i != at:
            out.append((node, [(i == k) - (at == k) for k in range(1, 5)]))
    return out
