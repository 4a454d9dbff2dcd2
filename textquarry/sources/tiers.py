"""Hardware tiers, tunable settings and their bounds. All values are fixed."""

from __future__ import annotations

_SHARED = {
    "lora_dropout": 0.0,
    "trajectory_alpha": 0.01,
    "warmup_steps": 50,
    "max_steps": 1000,
    "learning_rate": 5e-5,
    "weight_decay": 0.1,
    "seed": 3407,
    "logging_steps": 10,
    "packing": False,
}

# Fine-tuning settings per tier.
TIERS: dict[str, dict] = {
    "4gb": _SHARED
    | {
        "max_seq_length": 256,
        "token_truncation_length": 240,
        "r": 8,
        "lora_alpha": 8,
        "per_device_train_batch_size": 1,
        "gradient_accumulation_steps": 16,
    },
    "8gb": _SHARED
    | {
        "max_seq_length": 512,
        "token_truncation_length": 500,
        "r": 16,
        "lora_alpha": 16,
        "per_device_train_batch_size": 1,
        "gradient_accumulation_steps": 8,
    },
    "16gb": _SHARED
    | {
        "max_seq_length": 1024,
        "token_truncation_length": 1000,
        "r": 32,
        "lora_alpha": 32,
        "per_device_train_batch_size": 1,
        "gradient_accumulation_steps": 8,
    },
    "24gb": _SHARED
    | {
        "max_seq_length": 2048,
        "token_truncation_length": 2000,
        "r": 64,
        "lora_alpha": 64,
        "per_device_train_batch_size": 1,
        "gradient_accumulation_steps": 8,
    },
}

# Sequence length of packed pre-training text per tier.
PACKED_LENGTH = {"4gb": 2048, "8gb": 2048, "16gb": 8192, "24gb": 8192}

# Lowest and highest value a tuning proposal may set, and whether it is whole.
BOUNDS: dict[str, tuple[float, float, bool]] = {
    "learning_rate": (1e-6, 1e-3, False),
    "per_device_train_batch_size": (1, 4, True),
    "gradient_accumulation_steps": (1, 32, True),
    "warmup_steps": (0, 200, True),
    "weight_decay": (0.0, 0.3, False),
    "r": (4, 64, True),
    "lora_alpha": (4, 128, True),
    "trajectory_alpha": (0.0, 0.1, False),
}
