"""DuckDB oracle SQL for the driver's correctness check.

Relational operators are written directly as SQL.  Sequential learners are
checked with DuckDB ``list_reduce`` over the key's rows in (ts, id, x, y)
order: the accumulator holds the model state plus running confusion counts,
every element is mapped into the accumulator's struct type first, and dot
products are unrolled left to right (the order the fold uses), so the two
engines perform the same floating-point operations.
"""

from __future__ import annotations

from statistics import NormalDist

R = 6  # decimals compared


def rnd(e: str) -> str:
    """Round to R decimals and turn -0.0 into 0.0."""
    return f"(round(({e})::DOUBLE, {R}) + 0.0)"


def on_grid(e: str) -> str:
    """Round to a multiple of 2^-20, as the outlier factors are (powers and sines differ in the last bit between engines)."""
    return f"(floor(({e}) / {2.0 ** -20!r} + 0.5) * {2.0 ** -20!r})"


def _dot(a: str, b: str, d: int) -> str:
    return "(" + " + ".join(f"{b}[{j}] * {a}[{j}]" for j in range(1, d + 1)) + ")"


def _lst(items) -> str:
    return "[" + ", ".join(items) + "]"


def _sgn(s: str, tie: str) -> str:
    return f"(CASE WHEN {s} > 0 THEN 1.0::DOUBLE WHEN {s} < 0 THEN -1.0::DOUBLE ELSE {tie} END)"


def _acc(d, w, s="a.s", g="a.g", h="a.h", t="a.t", m="a.m", p=None):
    """New accumulator struct; p = the prediction expression for the counts."""
    pos_y, pos_p = "(e.y <> -1.0 AND e.c)", f"({p} <> -1.0)"
    cnt = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
    return (f"{{'w': {w}, 's': {s}, 'g': {g}, 'h': {h}, 't': {t}, 'm': {m}, "
            f"'tp': a.tp + {cnt(pos_y + ' AND ' + pos_p)}, 'fp': a.fp + {cnt('e.c AND NOT ' + pos_y + ' AND ' + pos_p)}, "
            f"'tn': a.tn + {cnt('e.c AND NOT ' + pos_y + ' AND NOT ' + pos_p)}, 'fn': a.fn + {cnt(pos_y + ' AND NOT ' + pos_p)}, "
            f"'x': e.x, 'y': e.y, 'q': e.q, 'c': e.c}}")


def step_sql(name: str, d: int, params: dict) -> str:
    """The lambda body (a = accumulator, e = element) of one learner."""
    S = _dot("a.w", "e.x", d)
    J = range(1, d + 1)
    if name == "perceptron":
        tie = float(params.get("tie", 0.0))
        P = _sgn(S, f"{tie!r}::DOUBLE")
        upd = _lst(f"a.w[{j}] + e.y * e.x[{j}]" for j in J)
        return f"CASE WHEN {P} <> e.y THEN {_acc(d, upd, m='a.m + 1', p=P)} ELSE {_acc(d, 'a.w', p=P)} END"
    if name == "pa":
        P = _sgn(S, "0.0::DOUBLE")
        L = f"greatest(0.0::DOUBLE, 1.0 - e.y * {P})"
        upd = _lst(f"a.w[{j}] + ({L} / (e.q * e.q) * e.y) * e.x[{j}]" for j in J)
        return (f"CASE WHEN {L} > 0 AND e.q > 0 THEN {_acc(d, upd, m='a.m + 1', p=P)} "
                f"WHEN {L} > 0 THEN {_acc(d, 'a.w', m='a.m + 1', p=P)} ELSE {_acc(d, 'a.w', p=P)} END")
    if name == "pa2":                                   # a rule of the caller's (U1): passive-aggressive with a soft margin
        P = _sgn(S, "1.0::DOUBLE")
        L = f"(1.0 - e.y * {S})"
        upd = _lst(f"a.w[{j}] + {L} / (e.q + {1 / (2 * float(params['C']))!r}) * e.y * e.x[{j}]" for j in J)
        miss = f"a.m + (CASE WHEN {P} <> e.y THEN 1 ELSE 0 END)"
        return f"CASE WHEN {L} > 0 THEN {_acc(d, upd, m=miss, p=P)} ELSE {_acc(d, 'a.w', p=P)} END"
    if name == "ogc":
        P = _sgn(S, "0.0::DOUBLE")
        c = f"((e.y - {P}) / (sqrt(e.q) + 1e-8))"
        upd = _lst(f"a.w[{j}] + {c} * e.x[{j}]" for j in J)
        return f"CASE WHEN {c} <> 0 THEN {_acc(d, upd, m='a.m + 1', p=P)} ELSE {_acc(d, 'a.w', p=P)} END"
    if name == "arow":
        r = float(params.get("r", 0.1))
        P = _sgn(S, "1.0::DOUBLE")
        lt = f"(1.0 - e.y * {S})"
        vt = "(" + " + ".join(f"e.x[{j}] * e.x[{j}] * a.s[{j}]" for j in J) + ")"
        den = f"({vt} + {r!r})"
        al, bt = f"({lt} / {den})", f"(1.0 / {den})"
        w = _lst(f"a.w[{j}] + {al} * e.y * a.s[{j}] * e.x[{j}]" for j in J)
        s = _lst(f"greatest(a.s[{j}] - {bt} * a.s[{j}] * a.s[{j}] * e.x[{j}] * e.x[{j}], 1e-10)" for j in J)
        return f"CASE WHEN {lt} > 0 THEN {_acc(d, w, s=s, m='a.m + 1', p=P)} ELSE {_acc(d, 'a.w', p=P)} END"
    if name in ("rda", "adarda"):
        P = _sgn(S, "1.0::DOUBLE")
        t = "(a.t + 1)"
        A, C = f"(({t} - 1)::DOUBLE / {t}::DOUBLE)", f"(1.0 / {t}::DOUBLE)"
        hit = f"(1.0 - e.y * {S} > 0)"
        g = _lst(f"(CASE WHEN {hit} THEN {A} * a.g[{j}] + {C} * (-e.y * e.x[{j}]) ELSE {A} * a.g[{j}] END)" for j in J)
        lam = float(params.get("lam", 1e-4 if name == "rda" else 1.0))
        if name == "rda":
            gam = float(params.get("gamma", 1.0))
            k = f"(sqrt({t}::DOUBLE) / {gam!r})"
            gj = lambda j: f"(CASE WHEN {hit} THEN {A} * a.g[{j}] + {C} * (-e.y * e.x[{j}]) ELSE {A} * a.g[{j}] END)"
            w = _lst(f"(CASE WHEN abs({gj(j)}) > {lam!r} THEN (-{k}) * ({gj(j)} - {lam!r} * sign({gj(j)})) ELSE 0.0 END)" for j in J)
            return f"CASE WHEN {hit} THEN {_acc(d, w, g=g, t=t, m='a.m + 1', p=P)} ELSE {_acc(d, w, g=g, t=t, p=P)} END"
        eta, delta = float(params.get("eta", 1.0)), float(params.get("delta", 1.0))
        h = _lst(f"(CASE WHEN {hit} THEN a.h[{j}] + (-e.y * e.x[{j}]) * (-e.y * e.x[{j}]) ELSE a.h[{j}] END)" for j in J)
        gj = lambda j: f"(CASE WHEN {hit} THEN {A} * a.g[{j}] + {C} * (-e.y * e.x[{j}]) ELSE {A} * a.g[{j}] END)"
        hj = lambda j: f"(CASE WHEN {hit} THEN a.h[{j}] + (-e.y * e.x[{j}]) * (-e.y * e.x[{j}]) ELSE a.h[{j}] END)"
        w = _lst(f"(CASE WHEN abs({gj(j)}) > {lam!r} THEN (-sign({gj(j)})) * ({eta!r} * {t}) / ({delta!r} + sqrt({hj(j)}) + 1e-8) ELSE 0.0 END)" for j in J)
        return f"CASE WHEN {hit} THEN {_acc(d, w, g=g, h=h, t=t, m='a.m + 1', p=P)} ELSE {_acc(d, w, g=g, h=h, t=t, p=P)} END"
    if name == "scw":
        C = float(params.get("C", 1.0))
        phi = NormalDist().inv_cdf(float(params.get("eta", 0.9)))
        P = _sgn(S, "1.0::DOUBLE")
        vt = "(" + " + ".join(f"e.x[{j}] * e.x[{j}] * a.s[{j}]" for j in J) + ")"
        mt = f"(e.y * {S})"
        phi2 = f"({phi!r} * {phi!r})"
        pa, xi = f"(1.0 + {phi2} / 2.0)", f"(1.0 + {phi2})"
        st = f"greatest(0.0::DOUBLE, {mt} * {mt} * {phi2} * {phi2} / 4.0 + {vt} * {phi2} * {xi})"
        al = f"least({C!r}, greatest(0.0::DOUBLE, (1.0 / ({vt} * {xi})) * (-{mt} * {pa} + sqrt({st}))))"
        su = f"greatest(0.0::DOUBLE, {al} * {al} * {vt} * {vt} * {phi2} + 4.0 * {vt})"
        ut = f"(0.25 * pow(-{al} * {vt} * {phi!r} + sqrt({su}), 2))"
        bt = f"(({al} * {phi!r}) / (sqrt({ut}) + {vt} * {al} * {phi!r} + 1e-8))"
        w = _lst(f"a.w[{j}] + {al} * e.y * a.s[{j}] * e.x[{j}]" for j in J)
        s = _lst(f"greatest(a.s[{j}] - {bt} * a.s[{j}] * a.s[{j}] * e.x[{j}] * e.x[{j}], 1e-10)" for j in J)
        cond = f"({phi!r} * sqrt({vt}) - {mt} > 0)"
        return f"CASE WHEN {cond} THEN {_acc(d, w, s=s, m='a.m + 1', p=P)} ELSE {_acc(d, 'a.w', p=P)} END"
    raise ValueError(name)


def fold_sql(src_sql: str, learners, d: int, keys=("stream",), order="ts, id, x, y",
             out_w: bool = True, count_expr: str = "true", init_sql: str | None = None, carry: bool = False) -> str:
    """Final state per (keys, algo): n, mistakes, w0..w{d-1}, tp, fp, tn, fn.

    ``count_expr`` (a boolean over the source row) selects the rows that enter
    the confusion counts; ``init_sql`` returns (keys, algo, w) start weights
    (other state starts fresh), as in a warm start; with ``carry`` it returns the whole state (w, s, g, h, t),
    which the result then has too.
    """
    ks = ", ".join(keys)
    z = _lst(["0.0::DOUBLE"] * d)
    one = _lst(["1.0::DOUBLE"] * d)
    q = "(" + " + ".join(f"x[{j}] * x[{j}]" for j in range(1, d + 1)) + ")"
    elem = (f"{{'w': {z}, 's': {z}, 'g': {z}, 'h': {z}, 't': 0::BIGINT, 'm': 0::BIGINT, 'tp': 0::BIGINT, "
            f"'fp': 0::BIGINT, 'tn': 0::BIGINT, 'fn': 0::BIGINT, 'x': x, 'y': y, 'q': {q}, 'c': ({count_expr})}}")

    def init(w):
        rest = "'s': _s0, 'g': _g0, 'h': _h0, 't': _t0" if carry and init_sql else f"'s': {one}, 'g': {z}, 'h': {z}, 't': 0::BIGINT"
        return (f"{{'w': {w}, {rest}, 'm': 0::BIGINT, 'tp': 0::BIGINT, "
                f"'fp': 0::BIGINT, 'tn': 0::BIGINT, 'fn': 0::BIGINT, 'x': {z}, 'y': 0.0::DOUBLE, 'q': 0.0::DOUBLE, "
                f"'c': false}}")
    parts = []
    for label, name, params in learners:
        body = step_sql(name, d, dict(params))
        if carry:
            wcols = ", r.w AS w, r.s AS s, r.g AS g, r.h AS h, r.t AS t"
        elif out_w == "raw":
            wcols = ", r.w AS w"
        elif out_w:
            wcols = "".join(f", {rnd(f'r.w[{j}]')} AS w{j - 1}" for j in range(1, d + 1))
        else:
            wcols = ""
        if init_sql:
            more = ", _i.s AS _s0, _i.g AS _g0, _i.h AS _h0, _i.t AS _t0" if carry else ""
            src = (f"(SELECT _seq.*, _i.w AS _w0{more} FROM _seq JOIN (SELECT * FROM _init WHERE algo = '{label}') _i "
                   f"USING ({ks}))")
            ini = init("_w0")
        else:
            src, ini = "_seq", init(z)
        parts.append(f"""SELECT {ks}, '{label}' AS algo, n, r.m AS mistakes{wcols},
  r.tp AS tp, r.fp AS fp, r.tn AS tn, r.fn AS fn
FROM (SELECT {ks}, n, list_reduce(seq, lambda a, e: {body}, {ini}) AS r FROM {src})""")
    union = "\nUNION ALL\n".join(parts)
    init_cte = f"_init AS ({init_sql}),\n" if init_sql else ""
    return f"""WITH _src AS ({src_sql}),
{init_cte}_seq AS (SELECT {ks}, count(*) AS n, list({elem} ORDER BY {order}) AS seq FROM _src GROUP BY {ks})
{union}"""


# ------------------------------------------------------------ kernel rules
def _let(expr: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``expr`` (a one-element list stands in for LET)."""
    return f"list_transform([{expr}], lambda {name}: {body})[1]"


_EMPTY_ONE = ("kpa", "kperceptron")
_SINGLE = ("kpa", "kperceptron", "kogc", "karow", "krda", "kscw", "kadarda")


def _scw_sql(v: str, m: str, phi: float, C: float, eps: str) -> tuple[str, str]:
    """alpha and beta of SCW-I, written out from the published closed form."""
    z, h = 1.0 + phi * phi, 1.0 + phi * phi / 2.0
    al = (f"least({C!r}::DOUBLE, greatest(0.0::DOUBLE, (-({m}) * {h!r} + sqrt(({m}) * ({m}) * {phi ** 4 / 4.0!r} + ({v}) * {phi * phi * z!r}))"
          f" / (({v}) * {z!r} + {eps})))")
    u = f"(-({al}) * ({v}) * {phi!r} + sqrt(({al}) * ({al}) * ({v}) * ({v}) * {phi * phi!r} + 4.0 * ({v}))) / 2.0"
    return al, f"(({al}) * {phi!r} / (({u}) + ({v}) * ({al}) * {phi!r} + 1e-8))"


def kernel_step_sql(name: str, d: int, params: dict) -> str:
    """The fold body of one kernel rule.  ``a.v`` is the list of vectors {x, id, a, p, q}, bound below are
    ``k`` (kernel values), ``f`` (score), ``t`` (row number), ``j`` (position of the row's own vector, 0 if none)."""
    p = {k: v for k, v in params.items()}
    gam = float(p.get("gamma", 1.0))
    batch = name not in _SINGLE
    dist = " + ".join(f"(s.x[{i}] - e.x[{i}]) * (s.x[{i}] - e.x[{i}])" for i in range(1, d + 1))
    kern = f"list_transform(a.v, lambda s: exp({-gam!r} * ({dist})))"
    idx = "range(1, len(a.v) + 1)"
    empty = "1.0::DOUBLE" if name in _EMPTY_ONE else "0.0::DOUBLE"
    score = f"(CASE WHEN len(a.v) = 0 THEN {empty} ELSE list_sum(list_transform({idx}, lambda i: k[i] * a.v[i].a)) END)"
    var = f"(CASE WHEN len(a.v) = 0 THEN 1.0::DOUBLE ELSE list_sum(list_transform({idx}, lambda i: k[i] * k[i] * a.v[i].p)) + {'0.0' if batch else '1e-8'} END)"
    own = "coalesce(list_position(list_transform(a.v, lambda s: s.id), e.id), 0)" if batch and name != "batch_kperceptron" else "0"
    pred = "(CASE WHEN f > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)" if name == "batch_kogc" else "(CASE WHEN f >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    soft = lambda g, lam: f"(sign({g}) * greatest(abs({g}) - ({lam}), 0.0::DOUBLE))"
    grad = "(CASE WHEN 1.0 - e.y * f > 0 THEN -e.y ELSE 0.0::DOUBLE END)"
    mg, gg = "a.mg", "a.gg"
    hit = touch = None                                  # a mistake is counted; an own vector changes
    new, old = None, None                               # (alpha, p, q) of a new vector; of the own vector s
    every = None                                        # p of all vectors s (with kernel k[i]) on a revisit
    if name == "kpa":
        hit, new = f"{pred} <> e.y", ("2.0 / (1.0 + 1e-8) * e.y", "1.0", "0.0")
    elif name in ("kperceptron", "batch_kperceptron"):
        hit, new = f"{pred} <> e.y", ("e.y", "1.0", "0.0")
    elif name == "kogc":
        hit, new = "e.y - sign(f) <> 0", ("(e.y - sign(f)) / (1.0 + 1e-8)", "1.0", "0.0")
    elif name == "karow":
        den = f"({var} + {float(p.get('r', 0.1))!r})"
        hit, new = "1.0 - e.y * f > 0", (f"(1.0 - e.y * f) / {den} * e.y", f"1.0 / (1.0 + 1.0 / {den})", "0.0")
    elif name in ("kscw", "batch_kscw"):
        phi = NormalDist().inv_cdf(float(p.get("eta", 0.9))) if name == "kscw" else float(p.get("phi", 0.5))
        al, be = _scw_sql("w", "e.y * f", phi, float(p.get("C", 1.0)), "1e-8")
        hit = f"{phi!r} * sqrt({var}) - e.y * f > 0"
        if name == "kscw":
            new = (_let(var, "w", f"{al} * e.y"), _let(var, "w", f"1.0 / (1.0 + {be})"), "0.0")
        else:
            new, old = (_let(var, "w", f"{al} * e.y"), "1.0", "0.0"), (f"s.a + {_let(var, 'w', f'{al} * e.y')}", None, "s.q")
            every = _let(var, "w", be)
    elif name in ("krda", "kadarda"):
        mg = f"(((t - 1)::DOUBLE / t) * a.mg + (1.0 / t) * {grad})"
        gg = f"(a.gg + {grad} * {grad})"
        lam = float(p.get("lam", 0.01))
        if name == "krda":
            c = f"(-(sqrt(t::DOUBLE) / {float(p.get('rda_gamma', 1.0))!r}) * {soft(mg, repr(lam))})"
        else:
            c = (f"(CASE WHEN abs({mg}) > {lam!r} THEN -sign({mg}) * {float(p.get('eta', 1.0))!r} * t / ({float(p.get('delta', 1.0))!r} + sqrt({gg}) + 1e-8) "
                 "ELSE 0.0::DOUBLE END)")
        hit, new = f"{c} <> 0", (f"{c} * e.y", "1.0", "0.0")
    elif name == "batch_kpa":
        tau = f"least({float(p.get('C', 1.0))!r}, (1.0 - e.y * f) / (1.0 + 1e-8)) * e.y"
        hit, new, old = "1.0 - e.y * f > 0", (tau, "1.0", "0.0"), (f"s.a + {tau}", "s.p", "s.q")
    elif name == "batch_karow":
        beta = f"(1.0 / ({var} + {float(p.get('r', 1.0))!r}))"
        al = f"(1.0 - e.y * f) * {beta} * e.y"
        hit, new, old, every = "1.0 - e.y * f > 0", (al, "1.0", "0.0"), (f"s.a + {al}", None, "s.q"), beta
    elif name == "batch_kogc":
        st = "2.0 * e.wt * e.y"
        hit, new, old = f"{pred} <> e.y", (st, "1.0", "0.0"), (f"s.a + {st}", "s.p", "s.q")
    else:                                               # p: sum of gradients, q: visits or sum of squares
        g = "(CASE WHEN e.y * f < 1.0 THEN -e.y * e.wt ELSE 0.0::DOUBLE END)" if name == "batch_kgradient" else grad
        more = {"batch_kgradient": "1.0", "batch_krda": "0.0", "batch_kadarda": f"{g} * {g}"}[name]
        lam = float(p.get("lam", 0.01))

        def value(tot, ext):
            if name == "batch_kgradient":
                return f"(-sqrt({ext}) * (({tot}) / ({ext})))"
            if name == "batch_krda":
                return f"(-(sqrt(t::DOUBLE) / {float(p.get('rda_gamma', 1.0))!r}) * {soft(f'(({tot}) / t)', repr(lam))})"
            h = f"({float(p.get('delta', 1.0))!r} + sqrt({ext}))"
            return f"(-({soft(f'({tot})', f'{lam!r} * {h}')}) / {h})"
        hit, touch = f"{g} <> 0", "true"
        new, old = (value(g, more), g, more), (value(f"(s.p + {g})", f"(s.q + {more})"), f"(s.p + {g})", f"(s.q + {more})")
    touch = touch or hit
    st = lambda al, pp, qq: f"{{'x': s.x, 'id': s.id, 'a': ({al})::DOUBLE, 'p': ({pp})::DOUBLE, 'q': ({qq})::DOUBLE}}"
    made = f"list_append(a.v, {{'x': e.x, 'id': e.id, 'a': ({new[0]})::DOUBLE, 'p': ({new[1]})::DOUBLE, 'q': ({new[2]})::DOUBLE}})"
    if old:
        pick = lambda body: f"list_transform({idx}, lambda i: list_transform([a.v[i]], lambda s: {body})[1])"
        if every:
            shrunk = f"greatest(s.p - z * (s.p * k[i]) * (s.p * k[i]), 1e-10)"
            changed = _let(every, "z", pick(f"CASE WHEN i = j THEN {st(old[0], shrunk, old[2])} ELSE {st('s.a', shrunk, 's.q')} END"))
        else:
            changed = pick(f"CASE WHEN i = j THEN {st(*old)} ELSE s END")
        vecs = f"CASE WHEN j > 0 AND ({touch}) THEN {changed} WHEN j = 0 AND ({hit}) THEN {made} ELSE a.v END"
    else:
        vecs = f"CASE WHEN {hit} THEN {made} ELSE a.v END"
    one = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
    body = (f"{{'v': {vecs}, 'mg': ({mg})::DOUBLE, 'gg': ({gg})::DOUBLE, 't': t, 'm': a.m + {one(hit)}, "
            f"'tp': a.tp + {one(f'e.y > 0 AND {pred} > 0')}, 'fp': a.fp + {one(f'e.y < 0 AND {pred} > 0')}, "
            f"'tn': a.tn + {one(f'e.y < 0 AND {pred} < 0')}, 'fn': a.fn + {one(f'e.y > 0 AND {pred} < 0')}, "
            "'x': e.x, 'y': e.y, 'id': e.id, 'wt': e.wt}")
    return _let(kern, "k", _let(score, "f", _let("a.t + 1", "t", _let(own, "j", body))))


def kernel_fold_sql(src_sql: str, learners, d: int, order: str = "ts, id, x, y", raw: bool = False) -> str:
    """Final kernel model per (stream, algo): n, mistakes, n_sv, sum_alpha, abs_alpha and the running counts;
    with ``raw`` the list of vectors ``v`` instead.  The source has stream, x, y, id and wt."""
    none = "[]::STRUCT(x DOUBLE[], id BIGINT, a DOUBLE, p DOUBLE, q DOUBLE)[]"
    cell = lambda x, y, i, w: (f"{{'v': {none}, 'mg': 0.0::DOUBLE, 'gg': 0.0::DOUBLE, 't': 0::BIGINT, 'm': 0::BIGINT, 'tp': 0::BIGINT, "  # noqa: E731
                               f"'fp': 0::BIGINT, 'tn': 0::BIGINT, 'fn': 0::BIGINT, 'x': {x}, 'y': {y}, 'id': {i}, 'wt': {w}}}")
    zero = cell("[" + ", ".join(["0.0::DOUBLE"] * d) + "]", "0.0::DOUBLE", "0::BIGINT", "1.0::DOUBLE")
    elem = cell("x", "y", "id", "wt")
    total = lambda e: rnd(f"coalesce(list_sum(list_transform(r.v, lambda s: {e})), 0.0)")
    cols = "r.v AS v" if raw else f"r.m AS mistakes, len(r.v)::BIGINT AS n_sv, {total('s.a')} AS sum_alpha, {total('abs(s.a)')} AS abs_alpha, r.tp AS tp, r.fp AS fp, r.tn AS tn, r.fn AS fn"
    parts = [f"""SELECT stream, '{label}' AS algo, n, {cols}
FROM (SELECT stream, n, list_reduce(seq, lambda a, e: {kernel_step_sql(name, d, dict(params))}, {zero}) AS r FROM _seq)"""
             for label, name, params in learners]
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH _src AS ({src_sql}),
_seq AS (SELECT stream, count(*) AS n, list({elem} ORDER BY {order}) AS seq FROM _src GROUP BY stream)
{union}"""


# ------------------------------------------------- study and bias forms
def study_step_sql(name: str, d: int, p: dict) -> str:
    """The fold body of a study or bias form, from its published rule.  Bound: ``f`` score, ``u`` = Sigma x
    (Sigma row-major in ``a.s``), ``v`` = x.u; later bindings depend on the rule."""
    J = range(1, d + 1)
    dot = lambda a, b: "(" + " + ".join(f"{a}[{j}] * {b}[{j}]" for j in J) + ")"
    vec = lambda f: _lst(f(j) for j in J)
    m, pred = "(e.y * f)", "(CASE WHEN f >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    num = lambda k, default: repr(float(p.get(k, default)))

    def acc(hit, w="a.w", s="a.s", g="a.g", h="a.h", b="a.b"):
        one = lambda c: f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
        pick = lambda new, old: f"(CASE WHEN {hit} THEN {new} ELSE {old} END)" if new != old else old
        return (f"{{'w': {pick(w, 'a.w')}, 's': {pick(s, 'a.s')}, 'g': {pick(g, 'a.g')}, 'h': {pick(h, 'a.h')}, 'b': {pick(b, 'a.b')}, "
                f"'t': a.t + 1, 'm': a.m + {one(hit)}, 'tp': a.tp + {one(f'e.y > 0 AND {pred} > 0')}, 'fp': a.fp + {one(f'e.y < 0 AND {pred} > 0')}, "
                f"'tn': a.tn + {one(f'e.y < 0 AND {pred} < 0')}, 'fn': a.fn + {one(f'e.y > 0 AND {pred} < 0')}, 'x': e.x, 'y': e.y}}")

    def rank1(c, when="true"):
        return _lst(f"a.s[{(i - 1) * d + j}] - (CASE WHEN {when} THEN {c} ELSE 0.0 END) * u[{i}] * u[{j}]" for i in J for j in J)
    wrong = f"{pred} <> e.y"
    if name == "pa_study":
        body = acc(f"{m} < 1", vec(lambda j: f"a.w[{j}] + (1.0 - {m}) / {dot('e.x', 'e.x')} * e.y * e.x[{j}]"))
    elif name in ("gradient", "ogc_live"):
        c = num("eta", 0.1) if name == "ogc_live" else "1.0"
        body = acc(f"{m} < 1", vec(lambda j: f"a.w[{j}] + {c} * e.y * e.x[{j}]"))
    elif name == "ogl":
        lr, l2, clip = num("lr", 0.01), num("l2", 0.01), p.get("clip", True)
        cut = lambda n, top: f"(CASE WHEN sqrt({dot(n, n)}) > {top} THEN {top} / sqrt({dot(n, n)}) ELSE 1.0 END)" if clip else "1.0"
        body = _let(vec(lambda j: f"-e.y * e.x[{j}] + {l2} * a.w[{j}]"), "r",
                    _let(vec(lambda j: f"a.w[{j}] - {lr} * (r[{j}] * {cut('r', '10.0')})"), "z",
                         acc(wrong, vec(lambda j: f"z[{j}] * {cut('z', '50.0')}"), b=f"a.b + {lr} * e.y")))
    elif name == "arow_full":
        den = f"(v + {num('r', 0.1)})"
        body = acc(f"1.0 - {m} > 0", vec(lambda j: f"a.w[{j}] + (1.0 - {m}) / {den} * e.y * u[{j}]"), rank1(f"(1.0 / {den})"))
    elif name == "arow_bias":
        bt = f"(1.0 / (greatest(v, 1e-10) + {num('r', 0.1)}))"
        al = f"greatest(0.0::DOUBLE, least(10.0::DOUBLE, (1.0 - {m}) * {bt}))"
        body = _let(al, "z", acc(f"{m} < 1", vec(lambda j: f"a.w[{j}] + (CASE WHEN z > 1e-10 THEN z ELSE 0.0 END) * e.y * u[{j}]"),
                                 rank1(bt, "z > 1e-10"), b="a.b + (CASE WHEN z > 1e-10 THEN z * e.y ELSE 0.0 END)"))
    elif name == "scw_full":
        phi = NormalDist().inv_cdf(float(p.get("eta", 0.9)))
        al, be = _scw_sql("v", m, phi, float(p.get("C", 1.0)), "0.0")
        body = acc(f"{phi!r} * sqrt(greatest(v, 0.0)) - {m} > 0", vec(lambda j: f"a.w[{j}] + {al} * e.y * u[{j}]"), rank1(be))
    elif name == "scw_bias":
        phi, C = float(p.get("phi", 1.0)), float(p.get("C", 1.0))
        conf = "least(100.0::DOUBLE, greatest(1e-10, v))"
        al = f"least({C!r}, greatest(0.0::DOUBLE, ({phi!r} - {m}) / ({conf} + {1 / (2 * C)!r})))"
        body = _let(al, "z", acc(f"{m} < {phi!r}", vec(lambda j: f"a.w[{j}] + (CASE WHEN z > 1e-10 THEN z ELSE 0.0 END) * e.y * u[{j}]"),
                                 rank1(f"(z * {conf} / (1.0 + z * {conf}))", f"z > 1e-10 AND z * {conf} < 1.0"),
                                 b="a.b + (CASE WHEN z > 1e-10 THEN z * e.y ELSE 0.0 END)"))
    else:
        lr, l1 = num("lr", 0.1 if name == "rda_bias" else 0.01), num("l1", 0.01 if name == "rda_bias" else 0.001)
        g = vec(lambda j: f"(a.t * a.g[{j}] - e.y * e.x[{j}]) / (a.t + 1)")
        if name == "rda_bias":
            step = f"({lr} / sqrt(a.t + 1.0))"
            w = vec(lambda j: f"(CASE WHEN abs(r[{j}]) > {l1} THEN -{step} * (r[{j}] - sign(r[{j}]) * {l1}) ELSE 0.0::DOUBLE END)")
            body = _let(g, "r", acc(wrong, w, g="r", b=f"a.b + {step} * e.y"))
        else:
            h = vec(lambda j: f"a.h[{j}] + e.x[{j}] * e.x[{j}]")
            rate = lambda j: f"({lr} / sqrt(z[{j}] + 1e-8))"
            w = vec(lambda j: f"(CASE WHEN abs(r[{j}]) > {l1} * {rate(j)} THEN -{rate(j)} * (r[{j}] - sign(r[{j}]) * {l1}) ELSE 0.0::DOUBLE END)")
            mean = "(" + " + ".join(rate(j) for j in J) + f") / {d}"
            body = _let(g, "r", _let(h, "z", acc(wrong, w, g="r", h="z", b=f"a.b + {mean} * e.y")))
    sx = vec(lambda i: "(" + " + ".join(f"a.s[{(i - 1) * d + k}] * e.x[{k}]" for k in J) + ")")
    return _let(f"{dot('a.w', 'e.x')} + a.b", "f", _let(sx, "u", _let(dot("e.x", "u"), "v", body)))


def study_fold_sql(src_sql: str, learners, d: int, order: str = "ts, id, x, y") -> str:
    """Final state per (stream, algo): n, mistakes, w0.., b and the running counts."""
    def cell(x, y, s0):
        eye = _lst(f"{s0 if i == j else 0.0!r}::DOUBLE" for i in range(d) for j in range(d))
        z = _lst(["0.0::DOUBLE"] * d)
        return (f"{{'w': {z}, 's': {eye}, 'g': {z}, 'h': {z}, 'b': 0.0::DOUBLE, 't': 0::BIGINT, 'm': 0::BIGINT, 'tp': 0::BIGINT, 'fp': 0::BIGINT, "
                f"'tn': 0::BIGINT, 'fn': 0::BIGINT, 'x': {x}, 'y': {y}}}")
    zero_x = _lst(["0.0::DOUBLE"] * d)
    ws = ", ".join(f"{rnd(f'r.w[{j}] * 64.0')} AS w{j - 1}_64" for j in range(1, d + 1))
    parts = [f"""SELECT stream, '{label}' AS algo, n, r.m AS mistakes, {ws}, {rnd('r.b')} AS b, r.tp AS tp, r.fp AS fp, r.tn AS tn, r.fn AS fn
FROM (SELECT stream, n, list_reduce(seq, lambda a, e: {study_step_sql(name, d, dict(params))}, {cell(zero_x, '0.0::DOUBLE', 0.1 if name == 'scw_bias' else 1.0)}) AS r FROM _seq)"""
             for label, name, params in learners]
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH _seq AS (SELECT stream, count(*) AS n, list({cell('x', 'y', 1.0)} ORDER BY {order}) AS seq FROM ({src_sql}) GROUP BY stream)
{union}"""
