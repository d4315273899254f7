"""Fixed values of the checks: texts, bands and codes, stated here on their own.

The oracle does not take them from the implementation, so a wrong text, band
or code there fails the comparison.
"""

# Current texts
REC_HIGH_BP = ('Consult a healthcare provider about blood pressure management', 'Target: < 130/80 mmHg')
REC_HIGH_CHOL = ('Discuss cholesterol management with your doctor', 'Target: LDL < 100 mg/dL')
REC_HIGH_SMOKE = ('Consider a smoking cessation program', 'Goal: Smoke-free within 3-6 months')
REC_MED_BP = ('Monitor blood pressure and reduce sodium intake', 'Target: < 2g sodium/day')
REC_MED_WEIGHT = 'Work on gradual weight reduction'
REC_MED_CHOL = ('Increase dietary fiber and reduce saturated fats', 'Target: 25-30g fiber/day')
REC_MED_GLUC = ('Reduce sugar and refined carbohydrates', 'Target: < 25g added sugar/day')
REC_MED_ALCO = ('Limit alcohol consumption', 'Target: < 2 drinks/week')
REC_LONG_INACTIVE = ('Begin regular physical activity', 'Target: 30 min walking, 5x/week')
REC_LONG_ACTIVE = ('Maintain current activity, consider adding variety', 'Target: 150 min moderate activity/week')
REC_LONG_CHECKUP = ('Schedule regular health monitoring', 'Target: Check-up every 6 months')
REC_LONG_TRACK = ('Track key health metrics at home', 'Monitor: BP and weight weekly')
REC_HIGH_FILLER = ('Continue current healthy practices', 'Maintain regular preventive care')
REC_MED_FILLER = ('Focus on balanced nutrition', 'Target: 5 servings fruits/vegetables daily')

# Texts of the older variant
REC1_HIGH_BP = 'Consult a physician immediately for hypertension management'
REC1_HIGH_CHOL = 'Schedule a lipid panel test and discuss treatment options with your doctor'
REC1_HIGH_SMOKE = 'Begin a smoking cessation program - this is the fastest way to reduce risk'
REC1_MED_BP = 'Monitor blood pressure daily and reduce sodium intake'
REC1_MED_CHOL = 'Increase dietary fiber and reduce saturated fat intake'
REC1_MED_GLUC = 'Reduce sugar and refined carbohydrate consumption'
REC1_MED_ALCO = 'Limit alcohol to 1-2 drinks per week maximum'
REC1_LONG_INACTIVE = 'Begin with 30 minutes of walking daily, gradually increase intensity'
REC1_LONG_ACTIVE = 'Maintain current activity level, consider adding strength training'
REC1_LONG_CHECKUP = 'Schedule regular health check-ups every 6 months'
REC1_LONG_MONITOR = 'Monitor blood pressure and blood glucose at home weekly'
REC1_HIGH_FILLER = 'Continue current healthy practices and maintain regular check-ups'
REC1_MED_FILLER = 'Focus on maintaining a balanced diet rich in vegetables and lean proteins'

# What a risk level means
RISK_CONTEXT = {'Very High': ('This score indicates a significantly elevated cardiovascular risk profile compared to the general population.',
               'A medical evaluation is recommended in the near future to discuss risk factors and preventive options.',
               'This is a risk assessment tool, not a diagnosis. Many individuals with elevated risk profiles maintain good heart health through '
               'appropriate lifestyle choices and medical guidance.'),
 'High': ('Your cardiovascular risk profile is above average for your demographic group.',
          'Consider discussing these results with your healthcare provider at your next visit.',
          'Lifestyle modifications can significantly improve your risk profile over time.'),
 'Moderate': ('Your risk profile is within the expected range but shows some areas for potential improvement.',
              'Focus on the suggested lifestyle adjustments and continue monitoring your health metrics.',
              'Regular monitoring and healthy habits can help maintain or improve your current profile.'),
 'Low': ('Your cardiovascular risk profile appears to be favorable.',
         'Continue your current healthy practices.',
         'Maintain regular check-ups to support continued heart health.')}
RISK_CONTEXT_V1 = {'Very High': ('This score indicates a significantly elevated cardiovascular risk compared to the average adult.',
               'Medical evaluation is strongly advised within the next 2 weeks.',
               'This is a risk assessment, not a diagnosis. Many individuals with elevated risk never develop heart disease when they take '
               'appropriate action.'),
 'High': ('Your cardiovascular risk is above average for your demographic group.',
          'Consider scheduling a check-up with your healthcare provider within the next month.',
          'Lifestyle modifications can significantly reduce this risk over time.'),
 'Moderate': ('Your risk level is within the expected range but shows some areas for improvement.',
              'Focus on the recommended lifestyle changes and monitor your health metrics.',
              'Regular monitoring and healthy habits can keep your risk from increasing.'),
 'Low': ('Your cardiovascular risk appears to be below average.',
         'Continue your current healthy practices.',
         'Maintain regular check-ups to ensure continued heart health.')}

# Advice and result texts
ADVICE = {'bmi_high': 'BMI is high. Begin calorie deficit + daily walking.',
 'bmi_low': 'BMI low. Increase healthy calorie intake.',
 'bp': 'High blood pressure detected. Reduce salt and fried foods.',
 'chol': 'Cholesterol elevated. Increase fiber, avoid fried foods.',
 'gluc': 'High sugar levels. Reduce sugar + refined carbs.',
 'smoke': 'Smoking increases cardiac risk. Consider quitting.',
 'alco': 'Alcohol raises BP. Reduce intake.',
 'inactive': 'Increase activity — 30 minutes walking daily.',
 'level_high': 'High cardiovascular risk. Medical consultation recommended.',
 'level_moderate': 'Moderate risk. Lifestyle changes recommended.',
 'level_low': 'Low risk. Maintain healthy habits.'}
BP_TEXT = {0: 'Normal blood pressure.',
 1: 'High normal blood pressure.',
 2: 'High blood pressure (Stage 1).',
 3: 'High blood pressure (Stage 2).',
 4: 'Severe hypertension. Seek immediate care.'}
BP_TEXT_DEFAULT = 'Unknown BP status.'
CHOLESTEROL_TEXT = {1: 'Cholesterol is normal.', 2: 'Cholesterol is above normal. Reduce oily foods.', 3: 'Very high cholesterol. Medical review recommended.'}
CHOLESTEROL_TEXT_DEFAULT = 'Unknown cholesterol level.'
GLUCOSE_TEXT = {1: 'Glucose levels within normal range.',
 2: 'Glucose above normal. Possible impaired glucose regulation.',
 3: 'Elevated glucose levels. Consider glucose tolerance testing.'}
GLUCOSE_TEXT_DEFAULT = 'Unknown glucose level.'

# What-if scenarios
SCENARIO_TEXT = {'quit_smoking': ('If you quit smoking',
                  'Significant long-term cardiovascular benefit',
                  'Quit Smoking',
                  'Reduces long-term cardiovascular risk by up to 50% within 5 years'),
 'become_active': ('If you become active',
                   'Regular physical activity improves cardiovascular function',
                   'Regular Physical Activity',
                   'Reduces heart disease risk by 30-40% through improved cardiovascular function'),
 'bp_reduction': ('If BP reduced by 15 mmHg',
                  'Blood pressure management is highly effective',
                  'Lower Blood Pressure',
                  'Reducing BP by 10-15 mmHg significantly lowers stroke and heart attack risk'),
 'combined': ('Combined: Quit smoking + BP reduction', 'Combining multiple lifestyle changes produces compounding health benefits', None, None),
 'optimal': (None, None, 'Optimal Lifestyle', 'Your current lifestyle choices are already optimal. Keep up the great work!')}

# Reference bands
BMI_WHO_BANDS = [('underweight', 0, 18.5),
 ('normal', 18.5, 25),
 ('overweight', 25, 30),
 ('obese_class1', 30, 35),
 ('obese_class2', 35, 40),
 ('obese_class3', 40, 100)]
AGE_BANDS = [('young', 0, 40), ('middle', 40, 60), ('senior', 60, 100)]
BP_BANDS = [('normal', (90, 120), (60, 80)),
 ('elevated', (120, 130), (60, 80)),
 ('hypertension_stage1', (130, 140), (80, 90)),
 ('hypertension_stage2', (140, 180), (90, 120)),
 ('hypertensive_crisis', (180, 250), (120, 150))]

# Form labels and their codes
CHOLESTEROL_LABELS = {'Normal (< 200 mg/dL)': 1, 'Above Normal (200-239 mg/dL)': 2, 'High (>= 240 mg/dL)': 3}
GLUCOSE_LABELS = {'Normal (< 100 mg/dL)': 1, 'Above Normal (100-125 mg/dL)': 2, 'High (>= 126 mg/dL)': 3}
