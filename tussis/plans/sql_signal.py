"""SQL spellings of framing, spectra and summaries over ``embeddings``."""

from __future__ import annotations


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n    ".join(parts)


def stats_select(source: str, name: str, digits: int = 9) -> str:
    return f"SELECT vec_id, round(avg(v), {digits}) AS {name}_mean, round(var_pop(v), {digits}) AS {name}_var FROM {source} GROUP BY vec_id"


class SignalSql:
    """CTE texts for one framing of 64-sample recordings, with a direct DFT."""

    def __init__(self, length: int, hop: int, samples: int = 64, sample: str = "x"):
        """``sample`` is an SQL expression over the stored value ``x``."""
        L, H = length, hop
        self.length, self.hop, self.bins = L, H, L // 2 + 1
        n_frames = 1 + (max(samples, L) - L) // H
        B = self.bins

        self.samples = f"""stored AS (SELECT vec_id, unnest(range(len(embedding))) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
    raw AS (SELECT vec_id, n, {sample} AS x FROM stored),
    samples AS (SELECT v.vec_id, CAST(g.n AS INTEGER) AS n, coalesce(raw.x, 0.0) AS x
      FROM (SELECT vec_id FROM embeddings) v CROSS JOIN range({max(samples, L)}) AS g(n) LEFT JOIN raw ON raw.vec_id = v.vec_id AND raw.n = g.n)"""
        self.frames = f"""frames AS (SELECT vec_id, CAST(f AS INTEGER) AS f, n - CAST(f AS INTEGER) * {H} AS k, x
      FROM samples JOIN range({n_frames}) AS g(f) ON n >= f * {H} AND n < f * {H} + {L})"""
        self.spectrum = f"""windowed AS (SELECT vec_id, f, k, x * (0.5 - 0.5 * cos(2 * pi() * k / {L - 1})) AS wx FROM frames WHERE x <> 0 OR k = 0),
    wave AS (SELECT CAST(b AS INTEGER) AS b, CAST(k AS INTEGER) AS k, cos(2 * pi() * b * k / {L}) AS c, sin(2 * pi() * b * k / {L}) AS s
      FROM range({B}) AS g(b), range({min(L, samples)}) AS h(k)),
    parts AS (SELECT vec_id, f, b, sum(wx * c) AS re, sum(wx * s) AS im FROM windowed JOIN wave USING (k) GROUP BY vec_id, f, b),
    spec AS (SELECT vec_id, f, b, sqrt(re * re + im * im) AS m FROM parts)"""
        self.zcr = f"""nb AS (SELECT vec_id, f, k, x, lag(x) OVER (PARTITION BY vec_id, f ORDER BY k) AS p FROM frames),
    zcr AS (SELECT vec_id, f, count(*) FILTER ((x < 0) <> (p < 0))::DOUBLE / {L - 1} AS v FROM nb GROUP BY vec_id, f)"""
        self.levels = "lev AS (SELECT vec_id, f, sqrt(avg(x * x)) AS v FROM frames GROUP BY vec_id, f)"

    @property
    def spectra(self) -> tuple[str, ...]:
        return (self.samples, self.frames, self.spectrum)

    def mel(self, rate: float, n_mels: int) -> str:
        L, B = self.length, self.bins
        top = f"(2595.0::DOUBLE * log10(1.0::DOUBLE + {rate} / 2.0::DOUBLE / 700.0::DOUBLE))"
        return f"""edges AS (SELECT i, CAST(least(greatest(floor({L + 1} * 700.0::DOUBLE * (pow(10.0::DOUBLE, i * {top} / {n_mels + 1} / 2595.0::DOUBLE) - 1.0::DOUBLE) / {rate}), 0), {B - 1}) AS INTEGER) AS e
      FROM range({n_mels + 2}) AS g(i)),
    tri AS (SELECT CAST(a.i AS INTEGER) AS mel, a.e AS l, c.e AS c, z.e AS r FROM edges a JOIN edges c ON c.i = a.i + 1 JOIN edges z ON z.i = a.i + 2),
    bank AS (SELECT mel, CAST(b AS INTEGER) AS b, CASE WHEN b < c THEN (b - l)::DOUBLE / (c - l) ELSE (r - b)::DOUBLE / (r - c) END AS w
      FROM tri, range({B}) AS g(b) WHERE b >= l AND b < r),
    grid AS (SELECT vec_id, f, mel FROM (SELECT DISTINCT vec_id, f FROM spec), (SELECT mel FROM tri)),
    banded AS (SELECT vec_id, f, mel, sum(m * m * w) AS p FROM spec JOIN bank USING (b) GROUP BY vec_id, f, mel),
    mel AS (SELECT vec_id, f, mel, greatest(coalesce(p, 0.0), 1e-10) AS power FROM grid LEFT JOIN banded USING (vec_id, f, mel))"""

    def mfcc(self, n_mels: int, n_mfcc: int) -> str:
        return f"""cep AS (SELECT vec_id, f, CAST(c AS INTEGER) AS c,
      sum(10 * log10(power) * cos(pi() * c * (2 * mel + 1) / {2 * n_mels})) * CASE WHEN c = 0 THEN sqrt(1.0 / {n_mels}) ELSE sqrt(2.0 / {n_mels}) END AS v
    FROM mel, range({n_mfcc}) AS g(c) GROUP BY vec_id, f, c),
    mfcc AS (SELECT vec_id, c, avg(v) AS mean, var_pop(v) AS var FROM cep GROUP BY vec_id, c)"""

    def centroid(self, rate: float) -> str:
        return f"cen AS (SELECT vec_id, f, sum(b * {rate} / {self.length} * m) / greatest(sum(m), 1e-10) AS v FROM spec GROUP BY vec_id, f)"

    def bandwidth(self, rate: float) -> str:
        return f"""bw AS (SELECT s.vec_id, s.f, sqrt(sum(pow(b * {rate} / {self.length} - c.v, 2) * m) / greatest(sum(m), 1e-10)) AS v
      FROM spec s JOIN cen c USING (vec_id, f) GROUP BY s.vec_id, s.f)"""

    def rolloff(self, rate: float) -> str:
        return f"""run AS (SELECT vec_id, f, b, sum(m) OVER (PARTITION BY vec_id, f ORDER BY b ROWS UNBOUNDED PRECEDING) AS upto,
        sum(m) OVER (PARTITION BY vec_id, f) AS whole FROM spec),
      ro AS (SELECT vec_id, f, min(b) * {rate} / {self.length} AS v FROM run WHERE upto >= 0.85 * whole - 1e-12 GROUP BY vec_id, f)"""

    def chroma(self, rate: float) -> str:
        return f"""noted AS (SELECT vec_id, f, m, CAST(round_even(12 * log2(b * {rate} / {self.length} / 440.0) + 69, 0) AS INTEGER) % 12 AS pc
        FROM spec WHERE b * {rate} / {self.length} >= 27.5),
      cls AS (SELECT vec_id, f, CAST(c AS INTEGER) AS pc FROM (SELECT DISTINCT vec_id, f FROM spec), range(12) AS g(c)),
      summed AS (SELECT vec_id, f, pc, coalesce(sum(m), 0.0) AS s FROM cls LEFT JOIN noted USING (vec_id, f, pc) GROUP BY vec_id, f, pc),
      chr AS (SELECT vec_id, f, pc, s / greatest(sum(s) OVER (PARTITION BY vec_id, f), 1e-10) AS v FROM summed)"""

    def feature_row(self, rate: float, n_mels: int, n_mfcc: int, digits: int = 6) -> str:
        """Every summary feature of a recording in one row."""
        cepstra = ", ".join(
            f"round(max({s}) FILTER (c = {c}), {digits}) AS mfcc_{c + 1}_{s}" for c in range(n_mfcc) for s in ("mean", "var")
        )
        tracks = {"zero_crossing_rate": "zcr", "spectral_centroid": "cen", "spectral_bandwidth": "bw", "spectral_rolloff": "ro", "chroma": "chr", "rms": "lev"}
        stats = [f"s_{c} AS ({stats_select(c, n, digits)})" for n, c in tracks.items()]
        ctes = with_ctes(
            *self.spectra, self.mel(rate, n_mels), self.mfcc(n_mels, n_mfcc),
            f"cepstra AS (SELECT vec_id, {cepstra} FROM mfcc GROUP BY vec_id)",
            self.zcr, self.levels, self.centroid(rate), self.bandwidth(rate), self.rolloff(rate), self.chroma(rate), *stats,
        )
        return f"{ctes} SELECT * FROM cepstra " + " ".join(f"JOIN s_{c} USING (vec_id)" for c in tracks.values())

    def mfcc_row(self, rate: float, n_mels: int, n_mfcc: int, digits: int = 6) -> str:
        cepstra = ", ".join(
            f"round(max({s}) FILTER (c = {c}), {digits}) AS mfcc_{c + 1}_{s}" for c in range(n_mfcc) for s in ("mean", "var")
        )
        ctes = with_ctes(*self.spectra, self.mel(rate, n_mels), self.mfcc(n_mels, n_mfcc))
        return f"{ctes} SELECT vec_id, {cepstra} FROM mfcc GROUP BY vec_id"
