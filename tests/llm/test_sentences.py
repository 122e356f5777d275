"""Sentence units: cases by hand, the chunked transducer against a plain loop."""

import numpy as np
import pytest

from marlstone.llm import sentences as S
from marlstone.llm.sentences import EMIT, STEP, run_transducer, sentence_ends, unit_ends

CASES = [
    "Mr. J. R. Keld left on Nov. 25.| It was over by 5 p.m.| Fees fell to approx. $0.23, vs. $10.15.", "Regulators moved first in the U.S.| The desk, i.e. the team, widened it to 10.5 bps.| zkRill, a rollup, grew.", "“We paused withdrawals.”| “Is this the bottom?” asked Ms. Okrand.| (The figures exclude Xesaf.)| Why?!",
    '"Nothing was hacked! We rotated the keys. That is all," Mr. K told the forum.| So far, so quiet…| The market waited... and then jumped.', "Title without mark|\n\nA wrapped\nline of text.|\n\n1. First item|\n2. Second item|\n\n• one|\n• two", "Coinwow! users reported delays of 3 minutes on Oct.\n20. It ended.".replace("20. It", "20.| It"),
    "„Die Brücke ist sicher. Es fehlt nichts“, schrieb Dr. Strelan am 19. Januar.| Das waren ca. 12,00 Euro, d. h. 1,43 Mio. Euro, z. B. auf Karsk.", "« Le pont est sûr. Rien n’a bougé », a écrit Karsk.| C’était prévisible !| Mme Pelmar, p. ex., a vendu dès 8 h.| « Fini. »| Oui.",
    "¡Nadie lo vio venir!| ¿Por qué?| «Suspendimos los retiros.»| Según el Sr. Hadrin, p. ej., no.", "По словам А. К. Стрелана, 25 апреля 2024 г. выросло на 25 млн. монет, т. е. на 2%.| «Мост в порядке. Ничего не пропало», — написала команда.", "价格跌至1.01美元。|“资金安全。没有移动。”Karsk在公告中写道。|市场在等待……随后上涨。|为什么？",
    "「安全だ。動いていない」と述べた。|（含まない。）|市場は待った……そして上昇した。", "“पुल सुरक्षित है। कोई राशि नहीं हिली,” Karsk ने लिखा।| डॉ. तारेल ने कहा।| क्यों?", "قال د. تاريل ذلك.| هل انتهى الهبوط؟| «الجسر آمن. لم تتحرك»، كتبت.", "Η τιμή έπεσε, π.χ. στη Karsk.| Γιατί δεν απάντησε κανείς;| Περίμενε· κινήθηκε.",
    "ราคา Zuwob ลดลง 28.5% หลังจากหยุด| รุ่น v0.7.4 แก้ไขแล้ว", "kept growing.|So far, so quiet…|\nHash rate fell.|St. Orrin said so.", "  leading blank.|  ", "no mark",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    parts = case.split("|")
    text, want, at = "".join(parts), [], 0
    for p in parts:
        at += len(p)
        if p.strip():
            want.append(len(text[:at].rstrip()))
    got = unit_ends([text])[0]
    assert got == want, [text[a:b] for a, b in zip([0, *got], got)]


def test_chunks_and_scan_equal_a_plain_loop():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 127, 128, 129, 5000):
        symbols = rng.integers(0, len(STEP), n)
        state, want = 0, []
        for s in symbols:
            want.append(EMIT[s, state])
            state = STEP[s, state]
        for chunk in (1, 7, 128):
            assert run_transducer(symbols, chunk).tolist() == [int(x) for x in want]


def test_edges(spark):
    long = "A sentence here. " * 50_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  \n ", "x"), (4, long, "x"), (5, "One. Two.", "x"), (5, "One. Two.", "x"), (6, "“never closed. Still two.", "x")], "doc_id long, text string, end_pos string")
    rows = sentence_ends(df, "doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.end_pos)
    assert set(by) == {4, 5, 6} and len(by[4]) == 50_000 and sorted(by[5]) == [4, 4, 9, 9] and by[6] == [14, 25]
    assert sentence_ends(df.limit(0), "doc_id").count() == 0


def test_units_cover_every_mark(folder):
    import duckdb

    for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet'").fetchall():
        ends = unit_ends([t])[0]
        assert ends == sorted(set(ends)) and (not t.strip() or ends[-1] == len(t.rstrip()))
    assert S.STATES == EMIT.shape[1]


def by_chunks(text, size):
    made = [S.chunk_events(c) for c in S.chunks(text, size)]
    states = S.entry_states(np.stack([S.transition(np.asarray(s, dtype=np.int64)) for s, _ in made]))
    return [e for (s, ends), k in zip(made, states) for e in S._risen(ends, run_transducer(np.asarray(s, dtype=np.int64), state=k))]


def odd_text(rng, pieces):
    parts = ["word ", "Word. ", "„offen ", "“zu” ", "«quote» ", "»rück« ", '"straight ', '." Then', "Mr. K ", "1. item\n", "\n2. next ", "\n\n", "\n \n", "\n• dot ", "...", "?! ", "价格。", "「引用。」", "ราคา ลดลง ", "ab c. ", " ; ", "κι; ", "   ", "10.5 ", "z.B. ", "”", "» ", ")” ", "Нет. Да ", "\n"]
    return "".join(rng.choice(parts) for _ in range(pieces))


def test_any_chunk_size_gives_the_same_units(folder):
    import duckdb

    rng = np.random.default_rng(3)
    texts = [odd_text(rng, 400) for _ in range(60)] + [odd_text(rng, 3).replace("ราคา ลดลง ", "") * 200 for _ in range(20)]
    given = [t for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet'").fetchall() if t]
    for text in [*texts, "\n\n".join(given), " ".join(given)]:
        want = unit_ends([text])[0]
        for size in (1, 40, 333, 1024, 10**7):
            assert by_chunks(text, size) == want


@pytest.mark.parametrize("piece", ["“Never closed. Next one. ", "„Nie zu. Weiter. ", '"', "”", "wait... ! ", ")”", ". ", "«", "a\n", "\n1. x", " “", "!”  "])
def test_time_is_linear(piece):
    import time

    text = piece * (4_000_000 // len(piece))
    began = time.process_time()
    unit_ends([text])
    assert time.process_time() - began < 40


def test_long_texts_are_cut_into_rows(spark, folder):
    import duckdb

    given = [t for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet'").fetchall() if t]
    rows = [(1, "\n\n".join(given)), (2, " ".join(given)), (2, "Short. One."), (3, None), (4, "“open. " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, sentence_ends(df, "doc_id", long_text=20_000, chunk=4096).collect()))
    assert got == sorted((k, e) for k, t in rows for e in unit_ends([t])[0])
