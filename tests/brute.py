"""Plain sequential versions of the similarity and of entity resolution."""


def jaro(a, b):
    if not a or not b:
        return 0.0
    reach = max(1, max(len(a), len(b)) // 2 - 1)
    taken, mine = set(), []
    for i, letter in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == letter:
                taken.add(j)
                mine.append(letter)
                break
    if not mine:
        return 0.0
    theirs = [b[j] for j in sorted(taken)]
    moved = sum(x != y for x, y in zip(mine, theirs)) / 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3.0


def jaro_winkler(a, b):
    score, lead = jaro(a, b), 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return score + lead * 0.1 * (1 - score)


def resolve(mentions, lexicon, threshold=0.88):
    """mentions (uid, raw, kind) in order; lexicon (raw, canonical, kind) in insert order."""
    rows, answers, added = list(lexicon), [], []
    for uid, raw, kind in mentions:
        name = (raw or "").strip()
        if not name or not kind:
            continue
        exact = [c for r, c, _ in rows if r.lower() == name.lower()]
        if exact:
            canonical = exact[0]
        else:
            scored = [(-jaro_winkler(name.lower(), c.lower()), c) for c in {c for _, c, k in rows if k == kind}]
            best = min(scored, default=(0.0, name))
            canonical = best[1] if -best[0] >= threshold else name
            rows.append((name, canonical, kind))
            added.append((name, canonical, kind))
        answers.append((uid, kind, raw, canonical))
    return answers, added
