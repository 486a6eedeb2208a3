"""Term lists, thresholds and texts of the screening rules."""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# They must equal the published rules for results to match.
# --------------------------------------------------------------------------

SYMPTOM_TERMS = {
    "fever": ["fever", "high fever", "temperature", "hot"],
    "cough": ["cough", "coughing"],
    "breathing": ["shortness of breath", "breathing", "breath", "chest tightness"],
    "sore_throat": ["sore throat", "throat pain"],
    "body_pain": ["body pain", "muscle pain", "body ache", "joint pain"],
    "fatigue": ["fatigue", "tired", "weak", "exhausted"],
    "cold": ["cold", "runny nose", "congestion", "flu"],
    "chills": ["chills", "shivering"],
}

EMERGENCY_TERMS = {
    "breathing emergency": ["severe difficulty breathing", "difficulty breathing", "gasping", "unable to speak", "inability to speak"],
    "blue/grey lips or skin": ["blue lips", "blue skin", "grey lips", "gray lips", "grey skin", "gray skin"],
    "sudden confusion": ["sudden confusion"],
    "severe chest tightness/heaviness": ["severe chest tightness", "chest heaviness", "severe chest pain"],
}

NEGATORS = ["no", "not", "none", "denies", "denied", "without", "negative for", "free of", "clear of", "absence of", "never", "zero"]

PLAN_TERMS = {
    "fever": ["covid", "fever", "chills", "high temperature", "myalgia"],
    "respiratory": ["asthma", "wheezing", "wheez", "whistle", "dyspnea", "stridor"],
    "productive": ["phlegm", "productive cough", "mucus", "green sputum", "yellow sputum", "pneumonia"],
    "copd": ["copd", "smoker", "chronic bronchitis", "emphysema"],
}

COPD_AGE = 60.0
DISEASE_PROBABILITY = 0.50
HIGH_RISK_PROBABILITY = 0.70
STRONG_SOUND_PROBABILITY = 0.75
CLEAN_SOUND_PROBABILITY = 0.40

FEVER_FLAG_LABEL = "fever/body pain"
RESPIRATORY_FLAG_LABEL = "respiratory condition"
NO_SYMPTOMS_LABEL = "No symptoms reported"

SOUND_HEALTHY = "Healthy / normal sound"
SOUND_MOSTLY_HEALTHY = "Mostly healthy sound with mild uncertainty"
SOUND_STRONG = "Strong abnormal respiratory sound"
SOUND_MODERATE = "Moderate abnormal respiratory sound"
SOUND_OTHER = "Acoustic sound evaluated"

SYMPTOMS_NONE = "No major symptoms reported"
SYMPTOMS_VIRAL = "Possible viral infection"
SYMPTOMS_RESPIRATORY = "Possible respiratory illness"
SYMPTOMS_OTHER = "Symptoms reported"
SYMPTOMS_EMERGENCY = "Emergency warning signs reported"

FINAL_URGENT = "Urgent medical attention needed"
FINAL_DISEASE = "Possible Disease"
FINAL_HEALTHY = "Healthy / normal"

SEVERITY_URGENT = "Urgent / Life-Threatening"
SEVERITY_DISEASE = "Elevated Acoustic Risk"
SEVERITY_HEALTHY = "Normal / Non-Pathological"

ADVICE_URGENT = (
    "Call your local emergency number or seek emergency care now. "
    "Do not rely on this screening result, especially if breathing is difficult."
)
ADVICE_DISEASE = (
    "Audio and clinical symptoms suggest abnormal acoustic markers consistent with Disease. "
    "Please consult a medical professional for evaluation."
)
ADVICE_HEALTHY = "No obvious abnormal sound or symptom pattern detected. Continue routine monitoring."

SUMMARY_DISEASE = "Disease Detected / Elevated Acoustic Risk"
SUMMARY_HEALTHY = "Healthy / Normal Respiratory Profile"
TIER_DISEASE = "P1 - ACUTE CLINICAL EVALUATION"
TIER_HEALTHY = "P3 - AMBULATORY CLEARANCE"
PHENOTYPE_DISEASE = "Turbulent High-Frequency Wheeze & Mucoidal Friction"
PHENOTYPE_HEALTHY = "Clean Laminar Airflow & Balanced Vocal Resonance"
SECRETION_TERMS = ["phlegm", "wet"]
SECRETION_HIGH = "Moderate to High"
SECRETION_NORMAL = "Normal / Trace"

CARE_PLANS = {
    "emergency": [
        ("🚨 Call Emergency Services Immediately", "Dial your local emergency number (112 / 911 / 108) without delay. Do not wait for symptoms to subside."),
        ("🫁 Maintain Upright Seated Posture", "Sit upright leaning slightly forward (tripod position) to maximize thoracic lung expansion."),
        ("💨 Administer Oxygen / Rescue Bronchodilator", "If prescribed, administer emergency rescue inhaler (Salbutamol) via spacer."),
        ("🚫 Avoid Heavy Physical Movement", "Remain completely still and calm to minimize cellular oxygen consumption."),
    ],
    "fever": [
        ("😷 Strict Isolation & Masking", "Isolate in a well-ventilated room. Wear a properly fitted N95/FFP2 respirator around others."),
        ("📊 Continuous Pulse Oximetry (SpO2)", "Check peripheral blood oxygen saturation every 4 hours. If SpO2 drops below 94%, seek urgent hospital evaluation."),
        ("🌡️ Antipyretic & Fever Protocol", "Monitor body temperature. Maintain adequate hydration with electrolyte-balanced fluids (2.5L–3.0L daily)."),
        ("💧 Saline Steam Inhalation", "Perform warm steam inhalation twice daily to soothe irritated bronchial mucous membranes."),
        ("👨‍⚕️ Clinical Consultation", "Schedule an evaluation with a certified medical doctor for confirmatory clinical testing."),
    ],
    "respiratory": [
        ("🫁 Use Prescribed Bronchodilator Inhaler", "Take your prescribed beta-2 agonist inhaler with a spacer as directed by your physician."),
        ("🚫 Eliminate Environmental Triggers", "Stay away from cold air, vehicle exhaust smog, active/passive cigarette smoke, dust mites, and pet dander."),
        ("📈 Monitor Peak Expiratory Flow (PEF)", "Record PEF meter readings if available. A drop below 80% of personal best indicates airway constriction."),
        ("🪑 Elevated Sleeping Elevation", "Sleep with head and chest elevated at 30–45 degrees to prevent nocturnal airway obstruction."),
    ],
    "productive": [
        ("🏥 Pulmonologist / Physician Chest Auscultation", "Undergo comprehensive physical chest examination; a chest X-ray or evaluation may be required."),
        ("💧 Airway Clearance & Mucolytics", "Maintain high warm fluid intake to thin bronchial mucus secretions. Avoid suppressing productive coughs."),
        ("📊 Monitor SpO2 and Respiratory Rate", "A resting respiratory rate exceeding 24 breaths/minute indicates increased work of breathing."),
        ("💊 Complete Full Prescribed Medication Course", "Take all prescribed medications exactly on schedule."),
    ],
    "copd": [
        ("🫁 Dual Bronchodilator Maintenance", "Continue regular prescribed maintenance inhalers as scheduled."),
        ("🌬️ Pursed-Lip Breathing Technique", "Inhale through nose for 2 seconds, exhale slowly through pursed lips for 4 seconds to reduce air trapping."),
        ("😷 Urban Particulate Protection", "Avoid outdoor exposure during peak traffic hours; wear an N95 mask in areas with high air pollution."),
        ("📊 Baseline SpO2 Monitoring", "Maintain resting oxygen saturation monitoring as advised by your healthcare provider."),
    ],
    "generic": [
        ("🩺 Clinical Pulmonology Consultation", "The bioacoustic waveform demonstrates turbulence characteristic of respiratory irritation."),
        ("📊 Check Baseline Oxygen & Temperature", "Measure resting oxygen saturation and monitor for fever spikes over the next 48 hours."),
        ("😷 Wear Face Mask in Public", "Use a face mask in shared spaces until clinical evaluation rules out contagious infection."),
        ("💧 Optimize Airway Hydration", "Drink plenty of warm water and avoid dry, dusty, or unventilated environments."),
    ],
    "healthy": [
        ("✅ Maintain Respiratory Wellness", "Acoustic envelope demonstrates normal laminar airflow and clear vocal resonance."),
        ("🏃 Routine Aerobic Exercise", "Continue regular physical exercise to maintain healthy alveolar capacity and cardiovascular endurance."),
        ("💧 Daily Hydration Baseline", "Consume 2 to 3 liters of water daily to maintain mucosal barrier integrity."),
        ("🌳 Clean Air Practices", "Enjoy outdoor activity in low-pollution environments (AQI < 50)."),
    ],
}
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class ClinicalTerms:
    """The lexicons of one deployment; every rule takes them as an argument."""

    symptoms: dict[str, list[str]]
    emergencies: dict[str, list[str]]
    plans: dict[str, list[str]]
    negators: list[str]


DEFAULT_TERMS = ClinicalTerms(SYMPTOM_TERMS, EMERGENCY_TERMS, PLAN_TERMS, NEGATORS)
