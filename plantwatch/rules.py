"""Rule tables. They are plain data: pass your own to the operators that take them.

Everything below is a fixed value: names, limits, probabilities and texts that results are compared on.
"""

# Machine types and the sensors each must report, in payload order.
REQUIRED_SENSORS = {
    "cnc_machine": ["spindle_speed", "temperature", "tool_wear", "vibration"],
    "conveyor_motor": ["rpm", "temperature", "power_consumption"],
    "hydraulic_press": ["hydraulic_pressure", "temperature", "cycle_time"],
    "robotic_arm": ["joint_load", "movement_delay", "motor_temperature", "positional_accuracy"],
    "industrial_turbine": ["rpm", "vibration", "temperature", "energy_output"],
    "cooling_system": ["coolant_flow_rate", "temperature", "pressure"],
    "welding_unit": ["arc_stability", "temperature", "energy_usage"],
    "assembly_robot": ["task_completion_rate", "alignment_accuracy", "cycle_efficiency", "temperature"],
}

# Vocabularies.
STATUSES = ["healthy", "warning", "critical", "offline"]
ANOMALY_TYPES = [
    "none", "overheating", "unstable_rpm", "pressure_drop", "excessive_tool_wear", "vibration_anomaly",
    "motor_overheating", "movement_delay_spike", "pressure_fluctuation", "coolant_reduction",
    "unstable_arc", "energy_spike", "alignment_degradation", "efficiency_drop",
]
TIMESTAMP_PREFIX = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"

# Sensor limits for any machine (inclusive), in the order they are tried.
SENSOR_LIMITS = {
    "temperature": (-10.0, 500.0), "rpm": (0.0, 20000.0), "spindle_speed": (0.0, 20000.0),
    "tool_wear": (0.0, 100.0), "vibration": (0.0, 100.0), "hydraulic_pressure": (0.0, 6000.0),
    "cycle_time": (0.0, 3600.0), "joint_load": (0.0, 500.0), "movement_delay": (0.0, 60.0),
    "positional_accuracy": (0.0, 100.0), "energy_output": (0.0, 10000.0), "coolant_flow_rate": (0.0, 500.0),
    "pressure": (0.0, 1000.0), "arc_stability": (0.0, 100.0), "energy_usage": (0.0, 1000.0),
    "task_completion_rate": (0.0, 200.0), "alignment_accuracy": (0.0, 100.0), "cycle_efficiency": (0.0, 100.0),
    "power_consumption": (0.0, 1000.0), "motor_temperature": (-10.0, 500.0),
}

# Stricter limits by machine type (inclusive), in the order errors are listed.
STRICT_LIMITS = {
    "conveyor_motor": {"rpm": (0, 5000), "temperature": (-10, 250), "power_consumption": (0, 50)},
    "hydraulic_press": {"hydraulic_pressure": (0, 6000), "temperature": (-10, 250), "cycle_time": (0, 120)},
    "cnc_machine": {"spindle_speed": (0, 20000), "temperature": (-10, 250), "tool_wear": (0, 100), "vibration": (0, 50)},
    "robotic_arm": {"joint_load": (0, 200), "movement_delay": (0, 10), "motor_temperature": (-10, 250),
                    "positional_accuracy": (0, 100)},
    "industrial_turbine": {"rpm": (0, 25000), "vibration": (0, 50), "temperature": (-10, 400), "energy_output": (0, 2000)},
    "cooling_system": {"coolant_flow_rate": (0, 500), "temperature": (-30, 100), "pressure": (0, 200)},
    "welding_unit": {"arc_stability": (0, 100), "temperature": (0, 500), "energy_usage": (0, 100)},
    "assembly_robot": {"task_completion_rate": (0, 200), "alignment_accuracy": (0, 100), "cycle_efficiency": (0, 100),
                       "temperature": (-10, 200)},
}

# Per anomaly type - reason; trigger metric; expected range; causes with percent; actions.
CATALOGUE = {
    "overheating": (
        "Machine temperature exceeded safe thermal operating threshold.", "temperature", "10.0 - 75.0 °C",
        [("Cooling System Degradation", 50), ("Blocked Vents / Airflow Path", 30), ("Mechanical Bearing Friction", 20)],
        ["Inspect cooling subsystem fluid levels and pump", "Verify exhaust fans and clean air intake paths",
         "Perform thermal imaging on active motor shafts"]),
    "motor_overheating": (
        "Robotic joint coil temperature breached safe thermal limits.", "motor_temperature", "10.0 - 75.0 °C",
        [("Actuator Internal Short / Electrical Fault", 40), ("Joint Lubrication Starvation", 40),
         ("Excessive Joint Physical Overload", 20)],
        ["Verify current draw on motor coils", "Apply high-pressure joint grease to active gears",
         "Audit robotic program payload weights"]),
    "unstable_rpm": (
        "Rotational velocity fluctuated outside nominal safety limits.", "rpm", "1000 - 5000 RPM",
        [("Drive Belt Slippage", 45), ("Tachometer Feedback Signal Noise", 35), ("VFD Regulator Failure", 20)],
        ["Inspect and retension motor drive belts", "Clean rotary encoder optical sensor surfaces",
         "Verify VFD voltage output stability"]),
    "pressure_drop": (
        "Hydraulic cylinder pressure dropped below minimum active thresholds.", "hydraulic_pressure", "2000.0 - 5000.0 PSI",
        [("Hydraulic Line Fluid Leakage", 50), ("Main Pump Cavitation", 30), ("Manifold Pressure Relief Valve Failure", 20)],
        ["Perform pressure decay leak test on high-pressure hoses", "Check hydraulic fluid tank levels and filter color",
         "Verify pilot-operated valve release spring tension"]),
    "coolant_reduction": (
        "Coolant flow rate degraded below required cooling thresholds.", "coolant_flow_rate", "10.0 - 100.0 L/min",
        [("Impeller / Pump Internal Blockage", 45), ("Flow Path Tube Blockage", 35), ("Gasket Failure at Valve Seals", 20)],
        ["Flush cooling pipeline to clear calcification", "Verify coolant pump impeller current draw",
         "Inspect control valve seals for leakage"]),
    "vibration_anomaly": (
        "Vibrational harmonics indicate structural mechanical imbalance.", "vibration", "0.0 - 5.0 mm/s",
        [("Spindle Shaft Misalignment", 45), ("Loose Base Mounting Anchor Bolts", 35), ("Internal Bearing Ball Pitting", 20)],
        ["Perform dual-axis dial indicator laser alignment", "Retighten structural base anchor bolts to spec",
         "Conduct ultrasound acoustic bearing check"]),
    "excessive_tool_wear": (
        "Spindle bit degradation exceeded nominal safety wear profiles.", "tool_wear", "0.0 - 60.0 %",
        [("Sub-optimal Feed/Speed Ratio", 50), ("Part Material Hardness Out-of-Spec", 30),
         ("Micro-chipping from Insufficient Fluid", 20)],
        ["Adjust cutting feed rate down by 15%", "Verify batch hardness certificate of raw stock",
         "Flush flood coolant nozzle path to clear chips"]),
    "movement_delay_spike": (
        "Axis positioning delay exceeded path interpolation thresholds.", "movement_delay", "0.0 - 2.0 s",
        [("Guideway Friction / Lack of Lubrication", 50), ("Servo Torque Current Limiting", 30),
         ("EtherCAT Bus Sync Packet Loss", 20)],
        ["Run automated guideway lubricating sequence", "Inspect linear guide rails for physical debris",
         "Verify network cable shielding integrity"]),
    "unstable_arc": (
        "Welding voltage current arc stability dropped below quality criteria.", "arc_stability", "85.0 - 100.0 %",
        [("Electrode Tip Contamination", 45), ("Shielding Gas Flow Disruption", 35), ("Wire Feeder Tension Variance", 20)],
        ["Perform automatic contact tip replacement", "Inspect gas nozzle for weld spatter buildup",
         "Check wire spool tension regulator setting"]),
    "energy_spike": (
        "Welder power consumption peaked above maximum safety parameters.", "energy_usage", "10.0 - 150.0 kW",
        [("High-Resistance Short to Ground", 40), ("Transformer Inductance Overload", 40), ("Electrical Input Grid Surge", 20)],
        ["Perform insulation megohmmeter wire test", "Inspect contactor relays for carbon arc pitting",
         "Install transient surge suppression module"]),
    "alignment_degradation": (
        "Robotic end-effector alignment accuracy drifted outside tolerance.", "alignment_accuracy", "95.0 - 100.0 %",
        [("Joint Backlash Drift", 40), ("Thermal Expansion of Tool Bracket", 35), ("Gripper Mechanical Wear", 25)],
        ["Execute robotic joint calibration sweep", "Verify bracket assembly bolt torque settings",
         "Replace worn rubber gripper pads"]),
    "efficiency_drop": (
        "Robot assembly cycle efficiency dropped below required standards.", "cycle_efficiency", "85.0 - 100.0 %",
        [("Minor Stop Occurrences / Sensor Stalls", 50), ("Part Supply Starvation Delay", 30),
         ("Motor Friction Load Increase", 20)],
        ["Audit photoelectric proximity sensor alignment", "Adjust line buffer feed queue parameters",
         "Conduct joint friction force diagnostic"]),
}
CATALOGUE_DEFAULT = (
    "Machine metrics drifted beyond safe operational envelopes.", "temperature", "N/A",
    [("General Mechanical Degradation", 100)], ["Conduct general preventative inspection"])

# Causes and actions of the three sensor-correlation rules, with their confidence.
HOT_AND_SHAKING = (
    0.85,
    [("Severe Bearing Wear & Lubrication Loss", 70), ("Spindle Shaft Misalignment", 20), ("Cooling System Degradation", 10)],
    ["Initiate immediate bearing grease injection", "Schedule dial-indicator laser shaft alignment check",
     "Verify fans and clean dust filters"])
HOT_AND_STARVED = (
    0.90,
    [("Cooling Subsystem Failure / Impeller Blockage", 75), ("Hydraulic Line Fluid Leakage", 15),
     ("Ambient Over-temperature Load", 10)],
    ["Shut down system, check impeller current and flush tubes", "Perform pressure decay test on line connections",
     "Verify coolant control valve opening ratio"])
SLOW_AND_HUNGRY = (
    0.80,
    [("Motor Coil Winding Short / Motor Degradation", 70), ("Mechanical Gear Binding / High Friction Load", 20),
     ("Electrical Ingress Grid Invariance", 10)],
    ["Perform motor winding resistance inspection", "Inspect mechanical gears for wear debris and alignment",
     "Verify transformer input relay voltage levels"])
BASE_CONFIDENCE = 0.60

# What a named cause means.
CAUSE_EXPLANATIONS = {
    "Cooling Fan Failure": "Friction or electrical decay in the exhaust fan winding, reducing airflow.",
    "Bearing Wear": "Pitting or lubrication starvation in the rotational bearings, increasing mechanical load.",
    "Misalignment": "Slight structural shift or loose base mounting bolts, causing laser-axis deviation.",
    "Sensor Drift": "Calibration decay in the thermocouple or transducer, reporting out-of-bounds telemetry.",
    "Hydraulic Line Fluid Leakage": "Fluid loss due to seals decay or micro-fissures in hydraulic hoses.",
    "Main Pump Cavitation": "Air bubbles trapped in the pump cylinder, causing vibration and pressure spikes.",
    "Drive Belt Slippage": "Belt wear or tension decay, leading to rotational speed fluctuations.",
    "Worn Gripper Pads": "Gripper rubber degradation leading to part slippage and alignment accuracy drops.",
    "Sub-optimal Feed/Speed Ratio": "Feed rate set too high relative to spindle RPM, overloading the cutting bit.",
    "Cooling System Degradation": "Reduced heat-exchanger efficiency due to low coolant flow or fan friction.",
    "Blocked Vents / Airflow Path": "Debris buildup in the machine casing blocks optimal thermal dissipation.",
    "Mechanical Bearing Friction": "Increased resistance on the active shaft due to grease degradation.",
}
EXPLANATION_WITH_CANDIDATES = "Correlated sensor readings indicate potential component fatigue."
EXPLANATION_WITHOUT_CANDIDATES = "Nominal operational checks indicate low structural risk."

# Causes assumed for a machine without candidates, by words in its type; the last is the rest.
TYPICAL_CAUSES = [
    (["hydraulic", "cooling"], [("Cooling Fan Failure", 0.12), ("Bearing Wear", 0.08), ("Sensor Drift", 0.05)]),
    (["cnc", "welding"], [("Sub-optimal Feed/Speed Ratio", 0.15), ("Bearing Wear", 0.07), ("Sensor Drift", 0.04)]),
    ([], [("Mechanical Bearing Friction", 0.10), ("Sensor Drift", 0.06)]),
]

# Word in the anomaly type; possible causes; operational impact. The last is the rest.
ACTIVE_ANOMALY_TEXTS = [
    ("overheating",
     ["Cooling fan degradation", "Excessive mechanical load", "Bearing friction increase", "Ventilation obstruction"],
     "Reduced efficiency, high risk of motor burnout and automatic thermal shutdown."),
    ("pressure",
     ["Hydraulic line leak", "Pump impeller damage", "Relief valve failure", "Sensor calibration drift"],
     "Loss of hydraulic force, degradation of cycle speed, and potential pressure safety release."),
    ("vibration",
     ["Spindle misalignment", "Loose mounting bolts", "Internal bearing wear", "Load imbalance"],
     "Accelerated component wear, noise level spikes, structural fatigue, and precision loss."),
    ("tool_wear",
     ["Spindle speed mismatch", "Sub-optimal feed rate", "Insufficient cooling fluid"],
     "Surface roughness defects, dimensional inaccuracies, and high risk of tool breakage."),
    ("",
     ["General mechanical fatigue", "Sensor calibration drift", "Electrical signal interference"],
     "Reduced efficiency and potential shutdown risk."),
]
DEFAULT_ACTION = "Inspect cooling assembly and check sensor calibration within 24 hours."

# Words in the anomaly type; alert explanation; alert action. The first hit wins.
ALERT_TEXTS = [
    (["overheating", "temperature"], "Coil temperature exceeded safe thermal operating limits.",
     "Clean cooling vents, check airflow path, and inspect heat exchanger."),
    (["rpm", "speed"], "Rotational velocity fluctuated outside nominal safety limits.",
     "Verify structural alignment and inspect motor shaft lubrication."),
    (["energy", "power", "spike"], "Electric current load exceeded maximum peak safety index.",
     "Inspect electrical relay breakers and check load distribution panels."),
    (["pressure"], "System pressure dropped below minimum active operating threshold.",
     "Check fluid levels, inspect pump valves, and search for hose leaks."),
    (["vibration", "shake"], "Vibrational harmonics indicate structural mechanical imbalance.",
     "Tighten mounting bolts, schedule re-alignment, and check bearings."),
    (["leak"], "Coolant or fluid level decay rate is higher than normal limits.",
     "Check mechanical seals, inspect safety gaskets, and tighten valves."),
]
ALERT_DEFAULT_EXPLANATION = "Machine parameters deviate from typical baselines (%s)."
ALERT_DEFAULT_ACTION = "Perform standard diagnostic inspect run and verify telemetry feed."

# Source anomaly; anomaly it can set off; least source severity.
CASCADES = [
    ("overheating", "unstable_rpm", 0.6),
    ("vibration_anomaly", "excessive_tool_wear", 0.5),
    ("pressure_drop", "overheating", 0.55),
    ("motor_overheating", "movement_delay_spike", 0.5),
    ("coolant_reduction", "pressure_fluctuation", 0.4),
    ("unstable_arc", "energy_spike", 0.5),
    ("alignment_degradation", "efficiency_drop", 0.45),
]

# Rule; source type; dependent types; change of each sensor per unit of source severity.
EXPOSURES = [
    ("cooling_failure", "cooling_system", ["cnc_machine", "robotic_arm", "industrial_turbine"],
     {"temperature": 8.0, "motor_temperature": 8.0}),
    ("turbine_vibration", "industrial_turbine", ["welding_unit", "conveyor_motor"],
     {"temperature": 4.0, "power_consumption": 1.5, "energy_usage": 2.0}),
    ("cnc_tool_wear", "cnc_machine", ["assembly_robot"], {"alignment_accuracy": -1.5, "cycle_efficiency": -2.0}),
    ("arm_overload", "robotic_arm", ["conveyor_motor"], {"rpm": -30.0}),
]

# Metric; statistic of a period; threshold to exceed; seconds of a period; periods in a row.
ALARMS = [
    ("validation_errors", "sum", 5.0, 60, 2),
    ("consumer_lag_seconds", "max", 30.0, 60, 2),
    ("job_failures", "sum", 0.0, 300, 1),
]

# Weight of each part of the health score.
HEALTH_WEIGHTS = {
    "temperature": 0.25, "vibration": 0.20, "power": 0.15, "pressure": 0.15, "efficiency": 0.15, "degradation": 0.10,
}

# Window name; length in seconds; prefix length of a bucket; minutes per bucket.
WINDOWS = {"15m": (900, 16, 1.0), "1h": (3600, 16, 1.0), "24h": (86400, 13, 60.0), "7d": (604800, 10, 1440.0)}

# Gauge limits - critical above/below, warning above/below.
GAUGES = {
    "temperature": {"column": "temperature", "critical_above": 75.0, "warning_above": 60.0},
    "pressure": {"column": "pressure", "critical_above": 20.0, "critical_below": 5.0, "warning_above": 15.0,
                 "warning_below": 8.0},
    "power": {"column": "power_consumption", "critical_above": 120.0, "warning_above": 95.0},
    "vibration": {"column": "vibration", "critical_above": 5.0, "warning_above": 3.5},
    "degradation": {"column": "degradation_level", "critical_above": 0.8, "warning_above": 0.4},
}


def causes_text(causes):
    """Causes as stored: ``name (NN%)`` joined by commas."""
    return ", ".join(f"{name} ({percent}%)" for name, percent in causes)


def actions_text(actions):
    """Actions as stored: numbered and joined by commas."""
    return ", ".join(f"{i}. {action}" for i, action in enumerate(actions, 1))


# Texts of the recommendations; case: advice, reason.
ADVICE_TEXTS = {
    "critical": ("Immediately inspect {machine} — machine is in CRITICAL state and requires urgent maintenance.",
                 "Machine {machine} ({kind}) has crossed critical operational thresholds."),
    "high_rate": ("Schedule emergency inspection of {machine}. Anomaly rate of {rate} exceeds safe operating threshold.",
                  "More than 1 in 5 telemetry events from {machine} are anomalous."),
    "worn": ("Plan preventive maintenance for {machine}. Degradation level at {percent}% indicates component wear.",
             "{machine} has a high degradation score of {level}/1.0 — approaching end-of-cycle threshold."),
    "rate": ("Monitor {machine} closely. Anomaly rate of {rate} is elevated.",
             "{machine} ({kind}) shows recurring anomaly patterns suggesting early-stage degradation."),
    "hot": ("Check cooling system of {machine}. Average temperature of {heat}°C is above safe operating limit.",
            "Sustained high temperature accelerates bearing wear and can cause motor burnout."),
    "fleet": ("Fleet-wide: {n} machines are in warning state. Consider scheduling a preventive maintenance window.",
              "High proportion of machines in warning status may indicate a systemic issue. Affected types: {kinds}."),
}

# Texts of the energy, root-cause and executive insights.
ENERGY_INSIGHT = ("{kind} machines consumed {used} kWh during the selected period, accounting for approximately {share}% of total factory energy usage. "
                  "Spindles and hydraulic pumps make up the remaining share. Continuous monitoring of {kind} wear could yield the highest cost-reduction opportunities.")
ROOT_CAUSE_INSIGHT = ('"{cause}" is the leading source of machine distress, accounting for {n} incidents ({share}% of total diagnosed cases) with {evidence} '
                      "({confidence}% confidence). Prioritizing repair orders for this failure mode will yield the highest drop in production risk.")
NO_ISSUE = "No active machine distress detected."
ACTION_NOW = "Schedule mechanical/electrical service for asset {machine} immediately. Focus: {reason}."
ACTION_SOON = "Schedule inspection for machine {machine} within 48 hours. Focus: {reason}."
ACTION_NONE = "Continue regular operational monitoring. Maintain standard sensor inspection interval."

# Texts of the activity insights.
ACTIVITY_LEADER = "Telemetry generation is concentrated in {kind} systems ({share}% share)."
ACTIVITY_UP = "Factory telemetry volume has increased by {trend}% compared to the previous period."
ACTIVITY_DOWN = "Factory telemetry volume has decreased by {trend}% compared to the previous period."
ACTIVITY_STABLE = "Telemetry generation is currently stable compared to the previous period."
ACTIVITY_ANOMALOUS = "Anomalous telemetry is highly elevated at {rate}%. Immediate hardware inspection advised."
ACTIVITY_SOUND = "Anomaly frequency remains stable despite changes in production activity."
ACTIVITY_NORMAL = "Activity levels indicate normal operational conditions."

# Texts of the pipeline's health.
PIPELINE_STALLED = "No new records arriving in the stream"
PIPELINE_ERRORS = "Validator error rate is {rate}%"
PIPELINE_NORMAL = "Pipeline operating normally"

# Texts of the risk timeline.
TIMELINE_EVENT = "Detected {kind} in operating parameters."
TIMELINE_STATE = "Machine transitioned to {state} health state due to elevated degradation levels."

# Maintenance advice by degradation level, from this level on; trend; advice.
MAINTENANCE = [
    (0.8, "Critical", "Schedule emergency inspection immediately (critical risk)."),
    (0.4, "Degrading", "Plan preventive maintenance inspection within 7 days."),
    (None, "Stable", "Continue regular operations. Schedule routine maintenance in 30 days."),
]
