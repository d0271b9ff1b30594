"""A record-at-a-time model in plain Python, written apart from the engine."""

from collections import defaultdict


def assign(kind, ts):
    name, *args = kind
    if name == "tumbling":
        return [(ts - ts % args[0], ts - ts % args[0] + args[0])]
    if name == "sliding":
        size, slide = args
        return [(s, s + size) for s in range(ts - ts % slide - size * 2 - slide, ts + 1) if s % slide == 0 and s <= ts < s + size]
    return [(ts, ts + args[0])]


def run(rows, kind, bound, lateness=0, add=lambda s, v: s + 1, zero=0, merge=lambda a, b: a + b):
    """rows: (key, value, ts) in arrival order. Returns sorted fires
    (key, start, end, result) in multiset form and late (arrival number, key)."""
    cells = defaultdict(dict)  # key -> window -> [state, fired]
    clock, fires, late = None, [], []

    def move(now):
        for key, own in cells.items():
            for w, c in list(own.items()):
                if not c[1] and w[1] <= now:
                    c[1] = True
                    fires.append((key, *w, c[0]))
                if w[1] + lateness <= now:
                    del own[w]

    for i, (key, value, ts) in enumerate(rows):
        for w in assign(kind, ts):
            own = cells[key]
            if kind[0] == "session":
                grown = True
                while grown:
                    grown = False
                    for x in own:
                        if x[0] <= w[1] and w[0] <= x[1]:
                            u = (min(x[0], w[0]), max(x[1], w[1]))
                            grown, w = grown or u != w, u
                if clock is not None and w[1] <= clock and w[1] + lateness <= clock:
                    late.append((i, key))
                    continue
                if w not in own:
                    state = zero
                    for x in [x for x in own if x[0] <= w[1] and w[0] <= x[1]]:
                        state = merge(state, own.pop(x)[0])
                    own[w] = [state, False]
            if clock is not None and w[1] <= clock:
                if w[1] + lateness <= clock:
                    late.append((i, key))
                    continue
                c = own.setdefault(w, [zero, False])
                c[0], c[1] = add(c[0], value), True
                fires.append((key, *w, c[0]))
                continue
            c = own.setdefault(w, [zero, False])
            c[0] = add(c[0], value)
        now = ts - bound
        if clock is None or now > clock:
            clock = now
            move(clock)
    move(10**18)
    return sorted(fires), sorted(late)
