"""Single-machine NumPy versions of the estimators, used as oracles only."""

import numpy as np


def concordance(event, time, risk):
    con = tie = comp = 0
    for i in range(len(time)):
        if not event[i]:
            continue
        for j in range(len(time)):
            if time[i] < time[j] or (time[i] == time[j] and not event[j]):
                comp += 1
                con += risk[i] > risk[j]
                tie += risk[i] == risk[j]
    return comp, con, tie


def cox(x, time, event, penalizer=0.1, steps=30):
    x, time, event = np.asarray(x, float), np.asarray(time, float), np.asarray(event, bool)
    n, p = x.shape
    mean, sd = x.mean(0), x.std(0, ddof=1)
    z = (x - mean) / sd
    beta = np.zeros(p)
    for _ in range(steps):
        w = np.exp(z @ beta)
        grad, info = np.zeros(p), np.zeros((p, p))
        for t in np.unique(time[event]):
            r, d = time >= t, (time == t) & event
            k = d.sum()
            s0, s1 = w[r].sum(), w[r] @ z[r]
            s2 = (z[r] * w[r][:, None]).T @ z[r]
            q0, q1 = w[d].sum(), w[d] @ z[d]
            q2 = (z[d] * w[d][:, None]).T @ z[d]
            grad += z[d].sum(0)
            for l in range(k):
                f = l / k
                a0, a1, a2 = s0 - f * q0, s1 - f * q1, s2 - f * q2
                grad -= a1 / a0
                info += a2 / a0 - np.outer(a1, a1) / a0**2
        grad -= n * penalizer * beta
        info += n * penalizer * np.eye(p)
        step = np.linalg.solve(info, grad)
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta / sd, np.sqrt(np.diag(np.linalg.inv(info))) / sd
