"""The rule of compatible groups in plain Python, to hold the tables against."""


def _ignoring_n(a: str, b: str) -> int:
    return sum(x != y and x != "N" and y != "N" for x, y in zip(a, b, strict=True))


def build_groups(rows: list[tuple[str, float]], binom: bool) -> tuple[list[tuple[str, float]], int, int]:
    """Groups of compatible corrected svars: (sequence, depth) each, lost alleles, whether more may be lost.

    A component of the zero-distance graph that is a clique is a group.  From
    any other one the members with N are taken out; the rest form groups of
    equal sequence, and a member taken out gives its depth to those it fits.
    """
    rows = sorted(rows)
    n = len(rows)
    fits = [[_ignoring_n(a, b) == 0 for b, _ in rows] for a, _ in rows]
    left, groups, lost, more = set(range(n)), [], 0, 0
    while left:
        part, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in part:
                part.add(i)
                todo += [j for j in left if fits[i][j]]
        left -= part
        ids = sorted(part)
        if all(fits[i][j] for i in ids for j in ids):
            seqs = [rows[i][0] for i in ids]
            groups.append(("".join(next((x for x in col if x != "N"), "N") for col in zip(*seqs, strict=True)) if len(ids) > 1 else seqs[0], sum(rows[i][1] for i in ids)))
            continue
        out = [i for i in ids if "N" in rows[i][0]]
        stay = [i for i in ids if "N" not in rows[i][0]]
        if not stay:
            lost += 2
            more = max(more, int(len(out) > 2))
            continue
        depth: dict[str, float] = {}
        for i in stay:
            depth[rows[i][0]] = depth.get(rows[i][0], 0) + rows[i][1]
        given = dict(depth)
        donors = [i for i in out if any(fits[i][j] for j in stay)]
        others = [i for i in out if i not in donors]
        for i in donors:
            receivers = sorted({rows[j][0] for j in stay if fits[i][j]})
            beside = [j for j in others if fits[i][j]]
            if binom:
                if len([j for j in stay if fits[i][j]]) + len(beside) == 1:
                    given[receivers[0]] += rows[i][1]
            else:
                whole = sum(depth[s] for s in receivers) + sum(rows[j][1] for j in beside)
                for s in receivers:
                    given[s] += rows[i][1] * depth[s] / whole
        if len(stay) == 1:
            lost += 1
            more = max(more, int(len(out) > 1))
        elif others:
            lost += 1
            more = max(more, int(len(out) > 1))
        elif donors:
            more = 1
        groups += sorted(given.items())
    return groups, lost, more
