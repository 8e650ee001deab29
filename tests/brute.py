"""The matching rules once more, written from their description for small inputs.

A person becomes a ``Facts`` record of what the rules look at. Links are collected
over all ordered pairs and followed breadth first.
"""

from collections import deque
from dataclasses import dataclass

import regex

# Words that separate a town from what tells it from others, in order of precedence.
MARKERS = ["an der", "a.d.", "a. d.", "in der", "i.d.", "i. d.", "am", "a.", "im", "i.",
           "in", "bei", "b.", "ob der", "o.d.", "o. d.", "vor der", "v.d.", "v. d.", "unter", "u."]


def words(text):
    return tuple(regex.findall(r"[\p{L}\p{Nd}]+", (text or "").lower()))


def road(text):
    return tuple(regex.sub(r"str$", "strasse", w) for w in words((text or "").lower().replace("ß", "ss")))


def town(text):
    """``(name, addition)``: cut at a slash behind something, else at the first marker of the list."""
    text = (text or "").strip().lower()
    cuts = [regex.match(r"([^/]+)/(.*)", text, regex.S)]
    cuts += [regex.match(r"(.+?) " + regex.escape(m) + r" (.*)", text, regex.S) for m in MARKERS]
    for cut in filter(None, cuts):
        return cut[1].strip(), cut[2].strip().rstrip(".")
    return text, ""


def stands_for(short, long):
    """One byte that begins the other word."""
    return len(short.encode()) == 1 and long.startswith(short)


def one_in_other(a, b):
    small, large = sorted((a, b), key=len)
    return set(small) <= set(large) if len(a) != len(b) else set(a) <= set(b) or set(b) <= set(a)


def same_first(a, b):
    if not a or not b:
        return False
    by_letter = len(a) == len(b) and all(x == y or stands_for(x, y) or stands_for(y, x) for x, y in zip(a, b))
    return by_letter or one_in_other(a, b)


def same_last(a, b):
    return bool(a) and bool(b) and one_in_other(a, b)


def same_town(a, b):
    if not a[0] or a[0] != b[0]:
        return False
    x, y = a[1], b[1]
    return not x or not y or x == y or (x != y and any(stands_for(s, t) and len(t.encode()) > 1 for s, t in ((x, y), (y, x))))


@dataclass(frozen=True)
class Facts:
    id: int
    campus: int
    mail: str
    first: tuple
    last: tuple
    road: tuple
    town: tuple

    @classmethod
    def of(cls, row):
        listed = [e["email"] for e in row.get("emails") or []]
        mail = next((m.strip() for m in (row["email"], *listed) if (m or "").strip()), "").lower()
        return cls(row["person_id"], row["campus_id"], mail, words(row["first_name"]), words(row["last_name"]),
                   road(row["street"]), town(row["city"]))

    def buckets(self, swapped):
        """What two records need to share before names and addresses are compared."""
        if self.first and self.town[0] and self.road:
            yield "address", self.first[0], self.town[0], self.road
        if self.first and self.last:
            yield "name", self.first[0], self.last[0]
            if swapped:
                yield "either", frozenset((self.first[0], self.last[0]))


def at_one_address(a, b):
    return bool(a.road) and a.road == b.road and same_town(a.town, b.town)


def linked(a, b, swapped=False):
    """Rule for the ordered pair: ``a`` has the smaller id."""
    if a.mail and a.mail == b.mail:
        couple = a.campus == b.campus and at_one_address(a, b) and not same_first(a.first, b.first)
        return not couple
    if set(a.buckets(swapped)).isdisjoint(b.buckets(swapped)):
        return False
    if same_first(a.first, b.first) and (at_one_address(a, b) or same_last(a.last, b.last)):
        return True
    return same_first(a.first, b.last) and same_last(a.last, b.first)


def groups(persons, campus=None, swapped=False):
    """Clusters of at least two ids, each sorted; with ``campus`` those that have a member there."""
    facts = sorted((Facts.of(p) for p in persons), key=lambda f: f.id)
    near = {f.id: set() for f in facts}
    for i, a in enumerate(facts):
        for b in facts[i + 1:]:
            if a.id != b.id and linked(a, b, swapped):
                near[a.id].add(b.id)
                near[b.id].add(a.id)
    at_campus = {f.id for f in facts if f.campus == campus}
    found, seen = [], set()
    for start in near:
        if start in seen or not near[start]:
            continue
        cluster, queue = {start}, deque([start])
        while queue:
            fresh = near[queue.popleft()] - cluster
            cluster |= fresh
            queue.extend(fresh)
        seen |= cluster
        if campus is None or cluster & at_campus:
            found.append(tuple(sorted(cluster)))
    return sorted(found)
