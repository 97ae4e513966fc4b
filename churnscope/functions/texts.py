"""Fixed texts of the business rules.

Everything below is a fixed value that must equal the reference's wording for equal
results (labels, glossary, action and recommendation texts, explanation texts). They
are stated in the reference's own order. The logic that picks among them lives in
``operators/rules.py`` and ``operators/explain.py``.
"""

# ---------------------------------------------------------------------------
# Fixed values (reference wording).
# ---------------------------------------------------------------------------

# Business glossary: variable -> meaning.
GLOSSARY = {
    "ServicesOpted": "Number of services / products the customer uses",
    "Ages": "Customer age",
    "FrequentFlyer": "Whether customer is in the frequent-flyer (loyalty) program",
    "AnnualIncomeClass": "Customer income segment (Low/Middle/High)",
    "AccountSyncedToSocialMedia": "Customer connected account to social media",
    "BookedHotelOrNot": "Whether customer booked hotel (engagement indicator)",
}
GLOSSARY_DEFAULT = "Feature related to customer behaviour"

# Rule-based action per feature: (name part, first action, second action). Checked in
# this order; the first name part contained in the feature name decides. Which of the
# two actions applies (direction, or 'Low' in the name for income) is in
# ``operators/explain.recommended_action``.
ACTION_RULES = (
    ("ServicesOpted", "Offer targeted upsell bundle or 30-day free trial to increase engagement",
     "Highlight existing service benefits in retention messaging"),
    ("FrequentFlyer", "Target with loyalty incentives and travel benefits",
     "Maintain loyalty perks; consider cross-sell"),
    ("AnnualIncomeClass", "Offer budget bundles and flexible payment options",
     "Promote premium add-ons and concierge offers"),
    ("AccountSyncedToSocialMedia", "Prompt account completion and offer referral incentives",
     "Use social channels for retention campaigns"),
    ("BookedHotel", "Provide hotel loyalty rewards and special packages",
     "Upsell complementary travel services"),
    ("Age", "Use segment-specific offers (youth or senior campaigns)",
     "Maintain general retention messaging"),
)
ACTION_FALLBACK_UP = "Investigate root cause; consider targeted retention tests"
ACTION_FALLBACK_DOWN = "Leverage this feature in acquisition/retention messaging"

DIRECTION_UP = "increases churn"
DIRECTION_DOWN = "reduces churn"
DIRECTION_NEUTRAL = "neutral"

# Display names of numeric features and of categorical variables.
DISPLAY_NUMERIC = {"Ages": "Age", "ServicesOpted": "Services Opted"}
# Display names of encoded columns. An entry whose "(vs X)" names a category value that
# is not the variable's reference category is not used (the name is built from the
# category metadata instead).
DISPLAY_FEATURE = {
    "FrequentFlyer_No": "Not a Frequent Flyer (vs Yes)",
    "FrequentFlyer_No Record": "No Frequent Flyer Record (vs Yes)",
    "FrequentFlyer_Yes": "Frequent Flyer",
    "AnnualIncomeClass_High Income": "High Income (vs Low Income)",
    "AnnualIncomeClass_Middle Income": "Middle Income (vs Low Income)",
    "AccountSyncedToSocialMedia_Yes": "Social Media Connected (vs Not Connected)",
    "BookedHotelOrNot_Yes": "Booked Hotel (vs Not Booked)",
}
DISPLAY_VARIABLE = {
    "FrequentFlyer": "Frequent Flyer",
    "AnnualIncomeClass": "Income Class",
    "AccountSyncedToSocialMedia": "Social Media Sync",
    "BookedHotelOrNot": "Hotel Booking",
}

# Attribute-based recommendations, in the order they are added.
REC_AGE_YOUNG = "Target with youth-focused marketing campaigns and mobile app promotions"
REC_AGE_SENIOR = "Offer senior discounts, personalized service, and easy-to-use interfaces"
REC_INCOME = {
    "Low Income": "Provide budget-friendly service bundles and flexible payment options",
    "Middle Income": "Offer family packages and value-added services",
    "High Income": "Provide premium concierge services and exclusive benefits",
}
REC_SERVICES_LOW = "Upsell complementary services with 30-day free trial"
REC_SERVICES_HIGH = "Create custom bundle discount for loyalty and service optimization review"
REC_FLYER = {
    "Yes": "Reward with frequent flyer loyalty points and travel upgrades",
    "No Record": "Complete travel profile for personalized offers and travel preferences survey",
    "No": "Introduce travel benefits program with sign-up bonus",
}
REC_SOCIAL_YES = "Engage through social media exclusive offers and referral program"
REC_SOCIAL_NO = "Encourage social media connection for exclusive deals"
REC_HOTEL_YES = "Offer hotel loyalty rewards and room upgrade opportunities"
REC_HOTEL_NO = "Promote hotel booking packages with special discounts"
# Factor-based recommendations (top-3 factors).
REC_FACTOR_AGE = "Consider age-appropriate engagement strategies"
REC_FACTOR_INCOME_LOW = "Review pricing strategy for affordability"
REC_FACTOR_SERVICE = "Conduct service satisfaction survey"
MAX_RECOMMENDATIONS = 5
AGE_YOUNG_BELOW = 30
AGE_SENIOR_ABOVE = 50
SERVICES_LOW_MAX = 2
SERVICES_HIGH_MIN = 5

# Impact strength of one contribution.
IMPACT_LEVELS = ((0.1, "HIGH"), (0.05, "MEDIUM"), (0.01, "LOW"))
IMPACT_DEFAULT = "MINIMAL"

# Explanation texts: (key contained in the lower-cased display name, risk text, protective text).
RISK_TEXT_AGE_TEMPLATE = "Older age groups show {}higher churn rates"
RISK_TEXT_AGE_SIGNIFICANT_WORD = "significantly "
EXPLANATIONS = (
    ("age", None, "Age group shows lower churn propensity"),
    ("frequent flyer", "Frequent flyers are more likely to explore competitor offers",
     "Loyalty program participation increases retention"),
    ("income", "Income level strongly influences service affordability and retention",
     "Income stability supports service continuity"),
    ("services", "Number of services impacts overall customer commitment",
     "Service bundle reduces likelihood of switching"),
    ("social", "Social media connected customers are more exposed to competitor marketing",
     "Limited social exposure reduces competitive pressure"),
    ("hotel", "Hotel booking history indicates engagement with travel services",
     "Travel service engagement indicates satisfaction"),
)
RISK_TEXT_DEFAULT = "This feature significantly impacts churn prediction"
PROTECTIVE_TEXT_DEFAULT = "This feature reduces churn risk probability"
AGE_SIGNIFICANT = 0.05
RISK_TEXT_AGE_SIG = RISK_TEXT_AGE_TEMPLATE.format(RISK_TEXT_AGE_SIGNIFICANT_WORD)
RISK_TEXT_AGE = RISK_TEXT_AGE_TEMPLATE.format("")

# Key takeaways.
TAKEAWAY_RISKY = "Customer has significantly more risk factors than protective factors"
TAKEAWAY_PROTECTED = "Customer has strong protective factors against churn"
TAKEAWAY_BALANCED = "Balanced mix of risk and protective factors"
TAKEAWAY_PRIMARY_RISK = "Primary risk: {}"
TAKEAWAY_KEY_STRENGTH = "Key strength: {}"
TAKEAWAY_MULTIPLE = "Multiple factors ({}) significantly influence churn risk"
TAKEAWAY_FOCUS_RISK = "Focus interventions on addressing the top risk factors"
TAKEAWAY_FOCUS_STRENGTH = "Leverage existing strengths while addressing key risk areas"
TAKEAWAY_RATIO = 1.5
TAKEAWAY_MANY = 5
MAX_TAKEAWAYS = 5
TOP_FACTORS = 10
FACTORS_PER_SIDE = 5
FACTOR_RECS_FROM = 3

# Validation of one input record.
REQUIRED_FIELDS = ("Ages", "FrequentFlyer", "AnnualIncomeClass", "ServicesOpted", "AccountSyncedToSocialMedia",
                   "BookedHotelOrNot")
AGE_MIN, AGE_MAX = 18, 100
SERVICES_MIN, SERVICES_MAX = 1, 6
FLYER_VALUES = ("Yes", "No", "No Record")
# ---------------------------------------------------------------------------
