"""What travels to the tasks stays small, whatever the driver itself has hashed before."""

from __future__ import annotations

import random

from pyspark import cloudpickle

from cairnflow.llm import decontamination, near_dedup, text

LIMIT = 200_000


def test_kernels_and_automata_leave_the_hash_powers_behind():
    text.powers(text.BASE, 1 << 20)
    rnd = random.Random(3)
    items = [(str(i), " ".join(f"w{rnd.randrange(400)}" for _ in range(20))) for i in range(40)]
    automaton = cloudpickle.dumps(decontamination.Automaton(items))
    assert len(automaton) < LIMIT
    assert len(cloudpickle.dumps(near_dedup.signature_kernel)) < LIMIT
    assert len(cloudpickle.dumps(decontamination.hits)) < LIMIT
    assert cloudpickle.loads(automaton).windows == decontamination.Automaton(items).windows
    assert len(text._powers[text.BASE]) >= 1 << 20
