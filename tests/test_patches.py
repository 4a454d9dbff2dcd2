import math

import pytest

from textquarry.functions.parsing import extract_object
from textquarry.operators.patches import apply_patch, tunable
from textquarry.operators.rounds import settings_json
from textquarry.sources.tiers import BOUNDS

CONFIG = {"r": 16.0, "learning_rate": 5e-5, "warmup_steps": 50.0, "weight_decay": 0.1, "seed": 1.0}


def patched(spark, response, config=CONFIG):
    df = spark.createDataFrame([(config, response)], "config map<string,double>, response string")
    row = apply_patch(df.withColumn("patch", extract_object("response"))).first()
    return row["new_config"], row["changes"]


@pytest.mark.parametrize(
    "response, key, stored, change",
    [
        ('{"r": 128}', "r", 64, "  r: 16 → 64"),
        ('{"r": 1}', "r", 4, "  r: 16 → 4"),
        ('{"r": 16.5}', "r", 16, "  r: 16 → 16.5"),
        ('{"r": 17.0}', "r", 17, "  r: 16 → 17.0"),
        ('{"r": 64.0}', "r", 64, "  r: 16 → 64"),
        ('{"r": 16.0}', "r", 16, None),
        ('{"r": "32"}', "r", 16, None),
        ('{"r": null}', "r", 16, None),
        ('{"r": [32]}', "r", 16, None),
        ('{"r": 99999999999999999999}', "r", 64, "  r: 16 → 64"),
        ('{"optim": 3}', "r", 16, None),
        ('{"seed": 9}', "seed", 1, None),
        ('{"learning_rate": 5e-5}', "learning_rate", 5e-5, None),
        ('{"learning_rate": 0.0002}', "learning_rate", 2e-4, "  learning_rate: 5e-05 → 0.0002"),
        ('{"learning_rate": 1}', "learning_rate", 1e-3, "  learning_rate: 5e-05 → 0.001"),
        ('{"warmup_steps": true}', "warmup_steps", 1, "  warmup_steps: 50 → True"),
        ('{"warmup_steps": false}', "warmup_steps", 0, "  warmup_steps: 50 → 0"),
        ('{"lora_alpha": 32}', "lora_alpha", 32, "  lora_alpha: None → 32"),
        ('{"weight_decay": 0}', "weight_decay", 0, "  weight_decay: 0.1 → 0.0"),
        ("not json", "r", 16, None),
    ],
)
def test_golden_patches(spark, response, key, stored, change):
    config, changes = patched(spark, response)
    assert math.isclose(config[key], stored)
    assert changes == ([change] if change else [])
    assert {k: v for k, v in config.items() if k != key} == {
        k: v for k, v in CONFIG.items() if k != key
    }


def test_several_changes_at_once(spark):
    config, changes = patched(spark, '{"r": 8, "weight_decay": 0.5, "learning_rate": 5e-5}')
    assert changes == ["  weight_decay: 0.1 → 0.3", "  r: 16 → 8"]
    assert config == CONFIG | {"r": 8.0, "weight_decay": 0.3}


def test_tunable_and_json(spark):
    df = spark.createDataFrame([(CONFIG,), ({},)], "config map<string,double>")
    kept = [r[0] for r in df.select(tunable("config")).collect()]
    assert kept == [{k: v for k, v in CONFIG.items() if k in BOUNDS}, {}]
    shown = [r[0] for r in df.select(settings_json("config")).collect()]
    assert shown == [
        '{\n  "learning_rate": 5e-05,\n  "warmup_steps": 50,\n  "weight_decay": 0.1,\n  "r": 16\n}',
        "{}",
    ]


def test_clamp_bounds_are_inclusive(spark):
    for value in (4, 64):
        config, changes = patched(spark, f'{{"r": {value}}}')
        assert config["r"] == value and changes == [f"  r: 16 → {value}"]
