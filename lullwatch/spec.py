"""Parameters of the journal programs: vocabulary, thresholds and window lengths.

Operators never hard-code a literal of the journal; they take a ``JournalSpec``. The defaults below describe the
production journal, the test bed uses ``dataclasses.replace`` to shorten windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: journal vocabulary, vendor codes and physical ranges ------------------------------------------
STATUS_FAULT = "Неисправен"
STATUS_DISCONNECTED = "Отключено устройство"
STATUS_UNCERTAIN = ("Неопределен", "Не определено")
STATUS_POWER_OFF = "Обесточен"
STATUS_GAS = "Обнаружен газ"
KIND_LINK = "Пропадание связи"
KIND_VALUE = "Сбой значения"
GAS_SENSOR = "Газовый датчик"
PHASE_SENSOR = "Состояние фазы"
DATE_VALUE_PATTERN = r"^\s*\d{2}\.\d{2}\.\d{4}( \d{1,2}:\d{2}(:\d{2})?)?\s*$"
VENDOR_CODES = (-127.0, -100.0, 255.0, 327.68, -3276.8, -3276.0, 3276.7, 32767.0, -32768.0, 65535.0)
PHYSICAL_RANGES = {"Датчик температуры": (-55.0, 125.0), "Газовый датчик": (0.0, 100.0), "ИБП": (0.0, 100.0)}
# -------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RiskBounds:
    """Lower probability bounds of the levels above ``normal``."""

    attention: float = 0.2
    risk: float = 0.5
    critical: float = 0.8


@dataclass(frozen=True)
class JournalSpec:
    # vocabulary
    fault: str = STATUS_FAULT
    disconnected: str = STATUS_DISCONNECTED
    uncertain: tuple[str, ...] = STATUS_UNCERTAIN
    power_off: str = STATUS_POWER_OFF
    gas_detected: str = STATUS_GAS
    link_loss: str = KIND_LINK
    value_failure: str = KIND_VALUE
    gas_type: str = GAS_SENSOR
    phase_type: str = PHASE_SENSOR
    # value typing
    date_pattern: str = DATE_VALUE_PATTERN
    epoch_prefix: str = "01.01.1970"
    sentinel_codes: tuple[float, ...] = VENDOR_CODES
    sentinel_abs: float = 1000.0
    physical_ranges: dict = field(default_factory=lambda: dict(PHYSICAL_RANGES))
    gas_alarm: float = 1.0
    gas_explosive: float = 5.0
    work_hours: tuple[int, int] = (9, 13)
    # calendar
    data_end: str = "2026-07-01 00:00:00"
    grid_from: str = "2022-07-01"
    # gaps and the personal silence norm
    gap_min_s: int = 3600
    norm_floor_s: int = 6 * 3600
    norm_days: int = 30
    norm_tail: float = 0.01
    # journal outages
    outage_share: float = 0.01
    outage_hours: int = 168
    # mass and group silence
    mass_channels: int = 100
    group_min_h: int = 24
    group_min_share: float = 0.8
    group_min_channels: int = 5
    group_daily_min_events: int = 5
    group_tolerance_h: int = 12
    outage_day_min_s: int = 12 * 3600
    # labels
    horizon_h: int = 24
    exclude_h: int = 72
    # features: window name -> hours
    windows: dict = field(default_factory=lambda: {"1h": 1, "6h": 6, "24h": 24, "7d": 168, "30d": 720, "90d": 2160})

    @property
    def fault_statuses(self) -> tuple[str, str]:
        return (self.fault, self.disconnected)

    @property
    def base_kinds(self) -> tuple[str, str, str]:
        return (self.fault, self.disconnected, self.link_loss)
