"""The encoder of the token files: kept from task to task, words of small letters by the model alone."""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa

from wardlight.llm import token_files


def _json():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def test_a_worker_keeps_its_encoder_and_what_it_remembers(spark):
    sent = spark.sparkContext.broadcast(_json())

    def learn(batches):
        number = sum(batch.num_rows for batch in batches)
        encoder = token_files._encoder(sent.value, "<u2")
        known = len(encoder.memo)
        encoder.batch([f"word{number} task{len(encoder.memo)}"], b"")
        yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()], pa.int64()), "known": pa.array([known], pa.int64())})

    made = spark.range(0, 12, 1, 12).mapInArrow(learn, "pid bigint, known bigint").collect()
    workers = {row.pid for row in made}
    assert len(workers) < 12 and sum(row.known == 0 for row in made) <= len(workers)


def test_tokenizers_alike_at_their_start_are_told_apart():
    json = _json()
    other = json + " "
    assert json[:200] == other[:200]
    first = token_files._encoder(json, "<u2")
    assert token_files._encoder(json, "<u2") is first and token_files._encoder(other, "<u2") is not first


def test_words_of_small_letters_are_encoded_as_by_the_library():
    encoder = token_files._Encoder(_json(), "<u2")
    rng = np.random.default_rng(5)
    letters = list(token_files._LETTERS + token_files._LETTERS.upper() + "İΣσςªº'ß́長1.")
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3000)] + [*letters, "straße", "a" * 300]
    expected = [np.array(encoder.tokenizer.encode(w, add_special_tokens=False).ids, "<u2").tobytes() for w in words]
    assert encoder.direct and encoder.batch(words, b"") == expected
