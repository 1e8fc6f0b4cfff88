"""Small dimensions of the data model: bands, channels, groups, labels, tokens and texts."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 50.0)}
CHANNELS = ["Fp1", "Fp2", "F3", "F4", "F7", "F8", "Fz", "C3", "C4", "Cz", "P3", "P4", "P7", "P8", "Pz", "O1", "O2", "Oz", "T7", "T8"]
CHANNEL_GROUPS = {
    "central": ["C3", "C1", "Cz", "C2", "C4"],
    "frontal": ["FC3", "FC1", "FCz", "FC2", "FC4"],
    "parietal": ["CP3", "CP1", "CPz", "CP2", "CP4"],
    "left_motor": ["C3", "FC3", "CP3"],
    "right_motor": ["C4", "FC4", "CP4"],
}
LEVELS = {3: ["LOW", "MEDIUM", "HIGH"], 5: ["VERY_LOW", "LOW", "MEDIUM", "HIGH", "VERY_HIGH"]}
BAND_PRIORITY = ["beta", "alpha", "gamma", "theta", "delta"]
SPECIAL_TOKENS = ["<PAD>", "<UNK>", "<CLS>", "<SEP>", "<BOS>", "<EOS>", "<MASK>"]
STRUCTURE_TOKENS = [
    "<TASK_LEFT_HAND>", "<TASK_RIGHT_HAND>", "<TASK_FEET>", "<TASK_TONGUE>",
    "[CENTRAL:", "[FRONTAL:", "[PARIETAL:", "[LEFT_MOTOR:", "[RIGHT_MOTOR:",
    "<PATTERN:", "LEFT_DOMINANT", "RIGHT_DOMINANT", "BILATERAL", "BETA_ACTIVE", "ALPHA_PRESENT", "GENERAL",
]


@dataclass(frozen=True)
class Label:
    """A class: its id, name, short name, token, and texts that explain it."""

    id: int
    name: str
    short: str
    token: str
    spatial: str
    explanations: tuple[str, ...]


# Fixed values.
MOTOR_LABELS = [
    Label(1, "left hand motor imagery", "left hand", "<LEFT_HAND>", "- Right hemisphere dominance suggests left hand control", (
        "The EEG shows increased beta activity over right motor cortex, indicating left hand motor imagery.",
        "Beta suppression in the right hemisphere suggests preparation for left hand movement.",
        "Motor cortex lateralization pattern consistent with left hand motor imagery task.",
        "Right-sided sensorimotor rhythm changes indicate left hand movement imagination.",
    )),
    Label(2, "right hand motor imagery", "right hand", "<RIGHT_HAND>", "- Left hemisphere dominance suggests right hand control", (
        "Beta band suppression over left motor cortex indicates right hand motor imagery.",
        "Left hemisphere activation pattern suggests right hand movement preparation.",
        "EEG lateralization shows left motor cortex engagement for right hand task.",
        "Sensorimotor rhythm changes in left hemisphere indicate right hand imagery.",
    )),
    Label(3, "feet motor imagery", "feet", "<FEET>", "- Central activation suggests feet motor imagery", (
        "Central motor cortex activation pattern indicates feet motor imagery.",
        "Bilateral sensorimotor changes suggest foot movement imagination.",
        "EEG patterns over central regions consistent with feet motor imagery task.",
        "Motor cortex activity in foot representation area indicates feet movement.",
    )),
    Label(4, "tongue motor imagery", "tongue", "<TONGUE>", "- Central motor area activity indicates tongue imagery", (
        "Motor cortex activity in tongue representation area indicates tongue imagery.",
        "EEG patterns suggest tongue motor imagery with characteristic central activation.",
        "Sensorimotor rhythm changes consistent with tongue movement imagination.",
        "Central motor cortex patterns indicate tongue motor imagery task.",
    )),
]
# Names and sentences of the training examples.
TASKS = ["memory", "mathematic", "music", "eyesopen", "eyesclosed"]
INSTRUCTIONS = [
    "Analyze the following EEG motor imagery data and classify the intended movement:",
    "Given these EEG features, determine which motor imagery task was performed:",
    "Classify the motor imagery task based on these EEG patterns:",
    "What type of motor imagery does this EEG data represent?",
    "Examine these EEG features and identify the motor imagery task:",
]
CLASSIFY = "Classify EEG motor imagery:"
SYSTEM = "You are an expert in EEG analysis and motor imagery classification. Analyze the provided EEG features and classify the motor imagery task."
ENHANCEMENTS = [
    (("alpha",), "Alpha rhythm modulation supports the motor imagery task."),
    (("beta",), "Beta band activity indicates motor cortex engagement."),
    (("gamma",), "Gamma activity suggests focused attention during imagery."),
    (("c3", "left"), "Left motor cortex involvement is evident."),
    (("c4", "right"), "Right motor cortex activation is observed."),
    (("cz", "central"), "Central motor areas show characteristic patterns."),
]
OBSERVATIONS = [
    (("beta",), "- Beta band activity detected in motor cortex"),
    (("alpha",), "- Alpha rhythm modulation observed"),
    (("c3", "left"), "- Left motor cortex activation present"),
    (("c4", "right"), "- Right motor cortex activation present"),
]
REASONS = {
    "beta_hands": "beta band suppression in motor cortex indicates hand movement preparation",
    "beta": "beta band activity suggests motor planning",
    "alpha": "alpha rhythm modulation shows attention to motor task",
    "left": "left hemisphere motor cortex activation for right hand control",
    "right": "right hemisphere motor cortex activation for left hand control",
}
CONTRASTS = {
    "left_right": "hemispheric lateralization (left vs right motor cortex)",
    "right_left": "hemispheric lateralization (right vs left motor cortex)",
    "none": "distinct spatial and spectral patterns",
}
STEPS = ("Step 1: Analyze EEG features", "\nStep 2: Interpret spatial patterns", "\nStep 3: Classification")
ASK = "Please classify this EEG motor imagery pattern: "
ANSWER = "Based on the EEG patterns, this represents "

#: Peak-to-peak limits (volts) by kind of channel, above which an epoch is rejected.
REJECT = {"eeg": 100e-6, "eog": 150e-6}


def levels(n_bins: int) -> list[str]:
    """Names of the bins, lowest first."""
    return LEVELS.get(n_bins) or [f"BIN_{i}" for i in range(n_bins)]
