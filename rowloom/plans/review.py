"""External review decisions: hints, a choice among plans, and edited rows, each checked before it counts."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from rowloom.functions import lexicon as lx
from rowloom.plans import planner as pl

#: The schema of a decision. ``selected`` and ``edited_rows`` may be null.
DECISION = (
    "struct<protected_phrases:array<string>,preferred_block_sizes:array<int>,keep_single_rows:array<int>,"
    "merge_with_next_rows:array<int>,selected:int,edited_rows:array<string>,suggestions:array<string>,rationale:string>"
)


@dataclasses.dataclass
class Outcome:
    ok: bool
    reasons: list[str] = dataclasses.field(default_factory=list)
    rows: list[dict] | None = None
    hints: dict | None = None


def hints(rows: Sequence[pl.Row], decision: dict) -> Outcome:
    """The usable hints: block sizes of 1 to 3 that add up to the rows, row numbers of the group, phrases with words."""
    if not all(isinstance(decision.get(k), list) for k in ("protected_phrases", "preferred_block_sizes", "keep_single_rows", "merge_with_next_rows")):
        return Outcome(False, ["The planning hints are not valid"])
    own = {r.row_number for r in rows}
    sizes = [s for s in decision["preferred_block_sizes"] if type(s) is int]
    found = {
        "block_sizes": sizes if sizes and all(1 <= s <= 3 for s in sizes) and sum(sizes) == len(rows) else [],
        "phrases": [t for p in decision["protected_phrases"] if (t := pl.target_spacing(p))],
        "single_rows": [n for n in decision["keep_single_rows"] if n in own],
        "merge_rows": [n for n in decision["merge_with_next_rows"] if n in own],
    }
    return Outcome(True, hints=found) if any(found.values()) else Outcome(False, ["The planning hints were unusable"])


def choice(rows: Sequence[pl.Row], plans: Sequence[dict], selected, phrases, rationale: str, options: pl.Options) -> Outcome:
    """The chosen plan, unless there's none of that number, it's materially worse than the first (a style over 2 more,
    or any more with more blocks), or nothing can be planned under its phrases."""
    if type(selected) is not int or not isinstance(phrases, list):
        return Outcome(False, ["The candidate choice is not valid"])
    if not 0 <= selected < len(plans) or len(plans[selected]["rows"]) != len(rows):
        return Outcome(False, ["The selected candidate layout is out of range"])
    chosen, first = plans[selected], plans[0]
    style, best = ((p.get("score") or {}).get("style") or 0.0 for p in (chosen, first))
    more_blocks = ((chosen.get("score") or {}).get("blocks") or 0) > ((first.get("score") or {}).get("blocks") or 0)
    if selected and (style > best + 2 or (style > best and more_blocks)):
        return Outcome(False, ["The selected candidate is materially worse than the planner's best layout"])
    sizes = [len(b["row_numbers"]) for b in chosen["blocks"]]
    if phrases and pl.plan_group(rows, dataclasses.replace(options, block_sizes=sizes, phrases=phrases))["flagged"]:
        return Outcome(False, ["The selected candidate is invalid under its protected phrases"])
    return Outcome(True, [rationale] if rationale else [], [dict(r) for r in chosen["rows"]], {"block_sizes": sizes, "phrases": phrases})


def edits(rows: Sequence[pl.Row], base: Sequence[dict], edited, phrases, options: pl.Options) -> Outcome:
    """Edited rows, if they are as many, each is a valid line and no phrase of the caller straddles two."""
    if not isinstance(edited, list) or not isinstance(phrases, list):
        return Outcome(False, ["The edited rows are not valid"])
    if len(edited) != len(rows):
        return Outcome(False, ["The edit has the wrong number of rows"])
    new = [
        {"row_number": r.row_number, "target_text": pl.target_spacing(t), "strategy": base[i]["strategy"] if i < len(base) else "single"}
        for i, (r, t) in enumerate(zip(rows, edited, strict=True))
    ]
    for r, n in zip(rows, new, strict=True):
        if len(n["target_text"]) > options.limits_of(r.type)["hard_char_max"]:
            return Outcome(False, [f"Edited row {r.row_number} is not a valid line"])
    if phrases and pl.breaks_phrase([n["target_text"] for n in new], phrases):
        return Outcome(False, ["The edited rows split a protected phrase"])
    return Outcome(True, rows=new)


def reviewed(rows: Sequence[pl.Row], decision: dict | None, options: pl.Options) -> dict:
    """A group's plan with a decision folded in: hints plan anew, then a choice, then edits; what fails leaves a reason.

    A rationale counts as a reason, so a valid choice with one and nothing else isn't ``applied``."""
    pieces: dict[str, pl.Pieces] = {}
    group = pl.plan_group(rows, options, pieces)
    group |= {"attempted": False, "applied": False, "planning_applied": False, "edited": False, "protected": [], "suggestions": []}
    if len(rows) < 2:
        return group
    group["attempted"] = True
    if decision is None:
        return group | {"reasons": list(dict.fromkeys([*group["reasons"], "The review did not include this group"]))}
    decision = {k: v for k, v in decision.items()}
    for k in ("protected_phrases", "preferred_block_sizes", "keep_single_rows", "merge_with_next_rows", "suggestions"):
        decision[k] = [x for x in decision.get(k) or [] if x is not None]
    phrases, reasons, protected = decision["protected_phrases"], [], []
    found = hints(rows, decision)
    group["planning_applied"] = found.ok
    if found.ok:
        h = found.hints
        again = pl.plan_group(
            rows,
            dataclasses.replace(
                options, block_sizes=h["block_sizes"], phrases=h["phrases"], single_rows=frozenset(h["single_rows"]), merge_rows=frozenset(h["merge_rows"])
            ),
            pieces if list(h["phrases"]) == list(options.phrases) else None,
        )
        if not again["flagged"]:
            group |= again
            protected = list(h["phrases"])
    if decision.get("selected") is not None:
        got = choice(rows, group["plans"], decision["selected"], phrases, decision.get("rationale") or "", options)
        reasons += got.reasons
        if got.ok:
            group["rows"] = got.rows
            protected = list(dict.fromkeys([*protected, *phrases]))
    if decision.get("edited_rows"):
        got = edits(rows, group["rows"], decision["edited_rows"], phrases, options)
        reasons += got.reasons
        if got.ok:
            group |= {"rows": got.rows, "edited": True, "suggestions": decision["suggestions"]}
            protected = list(dict.fromkeys([*protected, *phrases]))
    group["protected"] = protected
    group["applied"] = group["planning_applied"] or group["edited"] or not reasons
    group["reasons"] = list(dict.fromkeys([*group["reasons"], *reasons]))
    return group


def broken_hint(originals: Sequence[str | None], rows: Sequence[dict]) -> bool:
    """Whether two neighbouring planned rows part a known two-word phrase of the original text."""
    joined = " ".join(t or "" for t in originals)
    known = {pl.target_spacing(p) for p in lx.HINT_PHRASES if p in joined}
    texts = [pl.line(r["target_text"]) for r in rows]
    return any(a.words and b.words and f"{a.words[-1]} {b.words[0]}" in known for a, b in zip(texts, texts[1:], strict=False))


def awkward(rows: Sequence[dict], plans: int, profile_id: str, n_rows: int) -> bool:
    """Whether a layout reads badly enough to be looked at."""
    if len(rows) < 3 or plans < 2:
        return False
    texts = [pl.line(r["target_text"]) for r in rows]
    broken = any(a.comma or (b.words and b.words[0] in lx.FLOW_CONNECTORS) for a, b in zip(texts, texts[1:], strict=False))
    singles = [t for r, t in zip(rows, texts, strict=True) if r["strategy"] == "single"]
    if profile_id == "nwn":
        return n_rows >= 4 or len(singles) >= 3 or broken or any(len(t.words) <= 3 for t in singles)
    return broken and len(singles) >= 2


def needs_review(group: dict, rows: Sequence[pl.Row], profile_id: str = "default", editing: bool = True) -> bool:
    """Whether a planned group is worth a review: flagged, a phrase parted, badly flowing, ambiguous, or worth editing."""
    plans = len(group["plans"])
    flow = awkward(group["rows"], plans, profile_id, len(rows))
    ambiguous = group["ambiguous"] and plans >= 2
    parted = broken_hint([r.target for r in rows], group["rows"])
    edit = editing and len(rows) >= 2 and (group["flagged"] or flow or profile_id == "nwn" or ambiguous)
    return bool(group["flagged"] or parted or flow or ambiguous or edit)
